"""The four dataflows: translate, audit, estimate, clean the memory."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.functions.casing import normalize_batch
from twinscript.operators import audits, costs, decks, lengths, memory, residual
from twinscript.session import staged
from twinscript.sources import files


@dataclass
class Translation:
    """What translating a corpus yields."""

    tm: DataFrame
    bilingual: DataFrame
    notes: DataFrame
    audit: DataFrame


def one_deck_per_source(missing: DataFrame) -> DataFrame:
    """Each missing text once, in the first deck that uses it: a call less per repetition."""
    first = F.min(F.struct("deck_id", "first_part", "first_idx", "n_uses"))
    return missing.groupBy("src").agg(first.alias("at")).select("src", "at.*")


def translate_corpus(
    segments: DataFrame,
    tm: DataFrame,
    translate: Callable[[list[str]], list[str]],
    glossary: DataFrame,
    condense: Callable[[Column], Column] | None = None,
    batch: int = rules.TRANSLATE_BATCH,
    rule: str = "identity",
    once: bool = True,
    kind: Callable[[Column], Column] | None = None,
) -> Translation:
    """Find gaps, translate them in batches, apply length and style rules, look everything up.

    ``kind`` names a source's kind for its length limit (``classify_segment_kind``); without it
    every source is a bullet.

    The answers are written once before anything reads them: a call is expensive
    and must not run again because a later stage does.
    """
    missing = memory.missing_sources(segments, tm, rule)
    batches = memory.assign_batches(one_deck_per_source(missing) if once else missing, batch)
    answers = staged(memory.translate_missing(batches, translate), "answers")
    # A source whose batch failed stays out of the memory, so that the next run finds it missing again.
    kinds = answers.filter("translated").select("deck_id", "batch_id", "pos_in_batch", "src", "tgt").withColumn("kind", F.lit("bullet") if kind is None else kind(F.col("src")))
    condensed = F.col("tgt") if condense is None else condense(F.col("tgt"))
    keys = ["deck_id", "batch_id", "pos_in_batch"]
    fitted = lengths.length_policy(kinds.withColumn("condensed", condensed), glossary, keys)
    updates = fitted.select("src", normalize_batch(F.col("text")).alias("tgt"))
    merged = memory.merge_tm(tm, updates)
    bilingual = memory.lookup_translations(segments, merged)
    n_missing = answers.groupBy("deck_id").agg(F.count("*").alias("n_missing"))
    notes = fitted.groupBy("src").agg(F.max("notes").alias("notes"))
    return Translation(
        tm=merged,
        bilingual=bilingual,
        notes=lengths.spilled_notes_by_slide(segments, notes),
        audit=decks.deck_audit(bilingual, n_missing, batch),
    )


@dataclass
class StyleAudit:
    issues: DataFrame
    counts: DataFrame
    gate: DataFrame


def style_audit(
    bilingual: DataFrame,
    glossary: DataFrame | None = None,
    alternatives: DataFrame | None = None,
    banned: dict[str, str] | None = None,
    max_issues: int = rules.GATE_MAX_ISSUES,
    critical: list[str] | None = None,
) -> StyleAudit:
    """All issues, their counts, and a verdict for every deck.

    Rows are checked once: the three results read the issues as written.
    """
    rows = bilingual if "kind" in bilingual.columns else audits.with_kind(bilingual)
    issues = staged(audits.all_issues(rows, glossary, alternatives, banned), "issues")
    return StyleAudit(
        issues, audits.issue_counts(issues), audits.quality_gate(issues, max_issues, critical, rows.select("deck_id"))
    )


def residual_report(parts: DataFrame, limit: int = 0, k: int = 10) -> dict[str, DataFrame]:
    """Summary, worst slides and gate from one table of per-slide counts."""
    by_slide = residual.script_chars_by_slide(parts)
    return {
        "by_slide": by_slide,
        "summary": residual.residual_summary(by_slide),
        "top": residual.top_residual_slides(by_slide, k),
        "gate": residual.residual_gate(by_slide, limit),
    }


def patch_residuals(bilingual: DataFrame, tm: DataFrame, filled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bilingual rows and memory after a filled worklist: what people wrote takes the place of residual texts."""
    patch = staged(residual.residual_patch(filled), "patch")
    return residual.patch_bilingual(bilingual, patch), residual.patch_memory(tm, patch)


def cost_estimate(
    blocks: DataFrame, pricing: DataFrame, also: list[str] | None = None, prefix_tokens: int = 0, prefix: str | None = None, **options
) -> tuple[DataFrame, DataFrame | None]:
    """The report per deck, and the same work, in the producer's tokens, under further models.

    ``prefix``, the text every request repeats, is counted by each model's own encoder; without
    it ``prefix_tokens`` holds for all.
    """
    report = costs.deck_cost_report(blocks, pricing, prefix_tokens=prefix_tokens, prefix=prefix, **options)
    if not also:
        return report, None
    shape = {k: options[k] for k in ("batch_size", "expansion", "chars_per_token") if k in options}
    billing = {k: options[k] for k in ("no_cache", "charge_write") if k in options}
    count = costs.producer_tokenizer(pricing, options.get("producer"), options.get("encoders"))
    work = costs.deck_workload(costs.token_totals(blocks, count), prefix_tokens=prefix_tokens, **shape)
    prefixes = None if prefix is None else costs.prefix_counts(pricing, also, prefix, options.get("encoders"))
    return report, costs.price_alternatives(work, pricing, also, **billing, prefixes=prefixes)


def clean_memory(spark: SparkSession, path: str, version: str, new_version: str) -> DataFrame:
    """Write a version without entries that need another translation; the old one stays as backup."""
    files.write_tm(memory.scrub_tm(files.read_tm(spark, path, version)), path, new_version)
    return files.read_tm(spark, path, new_version)
