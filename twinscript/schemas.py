"""Explicit schemas; nothing in the package infers one."""

from pyspark.sql import types as T

PARTS = "deck_id string, part_kind string, part_name string, part_no long, xml string"
SEGMENTS = "deck_id string, part_kind string, part_name string, part_no long, para_idx long, text string"
RUNS = (
    "deck_id string, part_kind string, part_name string, part_no long, frame_idx long, is_title boolean, "
    "record string, margins string, line_spacing string, font_size int, font_family string"
)
BILINGUAL_FILE = "slide string, idx string, src string, tgt string"
MEMORY = "src string, tgt string"
GLOSSARY = "term string, expected string"
PRICING = (
    "model string, provider string, `in` double, in_cached double, out double, "
    "cached_write double, cached_read double, tokenizer string"
)
PRICING_ENTRY = (
    "struct<`in`: double, in_cached: double, out: double, cached_write: double, cached_read: double, tokenizer: string>"
)
RUN_AUDIT = (
    "deck_id string, page long, unique_strings long, api_calls long, jp_chars_before long, jp_chars_after long, "
    "per_slide_before map<string,long>, per_slide_after map<string,long>"
)
ISSUES = ["category", "slide", "idx", "issue_type", "description", "suggested_fix"]

# One reviewer reply: category name -> list of findings.
DIAGNOSTICS = """struct<
  style: struct<
    title_case_violations: array<struct<index: long, text: string, issue: string, suggested_fix: string>>,
    bullet_terminal_punctuation: array<struct<index: long, text: string, issue: string, suggested_fix: string>>,
    parallelism_issues: array<struct<indices: array<long>, issue: string, note: string>>,
    glossary_violations: array<struct<index: long, term: string, expected: string, found: string, context: string>>,
    banned_phrases: array<struct<index: long, phrase: string, suggested: string, context: string>>,
    punctuation_errors: array<struct<index: long, issue: string, original: string, correct: string, context: string>>
  >,
  tone_flags: struct<
    added_hype: array<string>, softened_claims: array<string>, over_formalized: boolean, over_casual: boolean,
    deviation_from_deck_profile: array<string>
  >
>""".replace("\n", " ")

DECK_TONE = T.StructType(
    [
        T.StructField("register", T.StringType()),
        T.StructField("formality", T.IntegerType()),
        T.StructField("directness", T.IntegerType()),
        T.StructField("persuasiveness", T.IntegerType()),
        T.StructField("technicality", T.IntegerType()),
        T.StructField("audience", T.StringType()),
        T.StructField("style_notes", T.ArrayType(T.StringType())),
    ]
)
