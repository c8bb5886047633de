"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from twinscript.operators import audits, diagnostics, matching, memory, replies, residual, runs
from twinscript.plans import flows

ROW = "deck_id string, slide string, idx long, src string, tgt string"


@pytest.fixture
def segments(spark):
    rows = [
        ("d1", "s1", 0, "日本"), ("d1", "s1", 1, "plain"), ("d1", "s10", 0, "日本"), ("d1", "s2", 0, "東京 https://a.b/1"),
        ("d2", "s1", 0, "日本"), ("d2", "s1", 1, "大阪"),
    ]
    return spark.createDataFrame(rows, "deck_id string, part_name string, para_idx long, text string")


@pytest.fixture
def tm(spark):
    return spark.createDataFrame([("日本", "Japan"), ("大阪", "大阪"), ("plain", "other")], "src string, tgt string")


def test_lookup_and_apply(segments, tm):
    got = {(r.deck_id, r.slide, r.idx): r.tgt for r in memory.lookup_translations(segments, tm).collect()}
    assert got["d1", "s10", 0] == "Japan" and got["d1", "s2", 0] == "東京 https://a.b/1" and got["d1", "s1", 1] == "other"
    strict = {(r.deck_id, r.part_name, r.para_idx): r.new_text for r in memory.apply_tm_exact(segments, tm).collect()}
    assert strict["d1", "s1", 1] == "plain"
    every = {(r.deck_id, r.part_name, r.para_idx): r.new_text for r in memory.apply_tm_exact(segments, tm, False).collect()}
    assert every["d1", "s1", 1] == "other"


def test_empty_target(spark, segments):
    tm = spark.createDataFrame([("日本", "")], "src string, tgt string")
    assert memory.apply_tm_exact(segments, tm).filter("changed").count() == 0
    assert memory.apply_tm_exact(segments, tm, False).filter("new_text = ''").count() == 3


def test_missing_keeps_first_position(segments, tm):
    got = {(r.deck_id, r.src): (r.first_part, r.first_idx, r.n_uses) for r in memory.distinct_sources(segments).collect()}
    assert got["d1", "日本"] == ("s1", 0, 2)
    missing = {(r.deck_id, r.src) for r in memory.missing_sources(segments, tm).collect()}
    assert missing == {("d1", "東京 https://a.b/1"), ("d2", "大阪")}


def test_translate_retries_and_falls_back(spark, segments, tm):
    batches = memory.assign_batches(memory.missing_sources(segments, tm), 1)

    def flaky(texts):
        if "⟦URL_1⟧" in texts[0]:
            return [t.replace("東京", "Tokyo") for t in texts]
        raise RuntimeError("no answer")

    got = {r.src: (r.tgt, r.translated) for r in memory.translate_missing(batches, flaky, backoff=0.0).collect()}
    assert got == {"東京 https://a.b/1": ("Tokyo https://a.b/1", True), "大阪": ("大阪", False)}


def test_merge_and_scrub(spark, tm):
    new = spark.createDataFrame([("大阪", "Osaka"), ("京", "k京")], "src string, tgt string")
    merged = memory.merge_tm(tm, new)
    assert {r.src: r.tgt for r in merged.collect()} == {"日本": "Japan", "大阪": "Osaka", "plain": "other", "京": "k京"}
    assert {r.src for r in memory.scrub_tm(merged).collect()} == {"日本", "大阪", "plain"}


def test_consensus_breaks_ties_by_text(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("b", 1, "q"), ("b", 2, "p"), ("c", 1, "z")]
    df = spark.createDataFrame(rows, "src string, run_id int, tgt string")
    assert {r.src: (r.tgt, r.votes) for r in runs.consensus_merge(df).collect()} == {"a": ("y", 2), "b": ("p", 1), "c": ("z", 1)}
    assert tuple(runs.run_disagreement_totals(df).first()) == (3, 2, 2)
    assert {(r.src, r.tgt) for r in runs.run_disagreement(df).collect()} == {("a", "x"), ("a", "y"), ("b", "p"), ("b", "q")}


def test_glossary_checks(spark):
    glossary = spark.createDataFrame([("導入", "Implementation"), ("システム", "System")], "term string, expected string")
    rows = spark.createDataFrame(
        [("d", "s", 0, "導入", "Seamless deployment across regions"), ("d", "s", 1, "システム", "A [b]System[/b]")], ROW
    )
    (hit,) = matching.glossary_alternatives(rows, glossary, matching.alternatives_table(spark), ["idx"]).collect()
    assert (hit.idx, hit.term, hit.expected, hit.found) == (0, "導入", "Implementation", "deployment")
    assert [r.term for r in matching.glossary_missing(rows, glossary).collect()] == ["導入"]
    none = glossary.limit(0)
    assert matching.glossary_alternatives(rows, none, matching.alternatives_table(spark), ["idx"]).count() == 0
    assert matching.glossary_hits(rows, none).count() == 0


def test_banned_and_marks(spark):
    texts = spark.createDataFrame(
        [(0, "Our cutting-EDGE solution"), (1, "高性能、低コスト。"), (2, "「Smart」")], "idx int, text string"
    )
    banned = matching.dict_table(spark, {"Cutting-edge": "advanced"}, "phrase", "suggested")
    (hit,) = matching.banned_phrase_flags(texts, banned).collect()
    assert (hit.idx, hit.suggested) == (0, "advanced")
    from twinscript import rules

    marks = matching.dict_table(spark, rules.CHECKED_PUNCTUATION, "original", "correct")
    found = {(r.idx, r.original) for r in matching.punct_flags(texts, marks).collect()}
    assert found == {(1, "、"), (1, "。"), (2, "「"), (2, "」")}


def test_phrases_that_differ_in_case(spark):
    rows = spark.createDataFrame([("d", "s", 0, "", "robust Robust x")], ROW)
    banned = matching.dict_table(spark, {"Robust": "first", "robust": "second"}, "phrase", "suggested")
    for inline in (256, 0):
        got = sorted((r.word, r.suggested) for r in matching.banned_word_matches(rows, banned, inline=inline).collect())
        assert got == [("Robust", "second"), ("robust", "second")]


def test_bullet_checks(spark):
    rows = spark.createDataFrame(
        [(0, "[li-1] Increase revenue."), (1, "• Expand to APAC;"), (2, "• Expand to APAC. Start with Japan.")],
        "idx int, text string",
    )
    got = {r.idx: r.suggested_fix for r in audits.check_bullet_punct(rows, ["idx"]).collect()}
    assert got == {0: "[li-1] Increase revenue", 1: "• Expand to APAC"}
    titles = spark.createDataFrame([(0, "unlock the next wave of growth"), (1, "A sentence.")], "idx int, text string")
    assert [r.idx for r in audits.check_title_case(titles, ["idx"]).collect()] == [0]


def test_parallelism(spark):
    rows = [("b", i, t) for i, t in enumerate(["[li-1] Launching in Q4", "[li-2] Reduce churn", "[li-3] Expanding margins"])]
    df = spark.createDataFrame(rows, "batch_id string, index long, text string")
    (issue,) = diagnostics.parallelism_findings(df).collect()
    assert (issue.first_index, issue.last_index, issue.n_items, issue.n_gerund) == (0, 2, 3, 2)
    assert diagnostics.parallelism_findings(df.filter("index <> 1")).count() == 0


def test_diagnostics_round_trip(spark):
    rows = spark.createDataFrame(
        [("b", 0, "Keep as-is"), ("b", 1, "old old 。"), ("b", 2, "use foo here $1")],
        "batch_id string, index long, text string",
    )
    reply = """{"style": {"title_case_violations": [{"index": 5, "suggested_fix": "X"}],
      "bullet_terminal_punctuation": [{"index": -1, "suggested_fix": "X"}],
      "banned_phrases": [{"index": 99, "phrase": "foo", "suggested": "bar"}, {"index": 2, "phrase": "FOO", "suggested": "b$r"}],
      "punctuation_errors": [{"index": 42, "original": "。", "correct": ". "}, {"index": 1, "original": "。", "correct": ". "}],
      "glossary_violations": [{"index": 100, "found": "old", "expected": "new"}, {"index": 1, "found": "old", "expected": "new"}],
      "parallelism_issues": [{"indices": [0, 1], "issue": "i", "note": "n"}]},
      "tone_flags": {"added_hype": ["industry-leading"], "over_formalized": false}}"""
    replies_df = spark.createDataFrame([("b", reply)], "batch_id string, reply string")
    findings = diagnostics.parse_diagnostics(replies_df)
    assert findings.count() == 10
    fixed = {r["index"]: r.fixed for r in diagnostics.apply_diagnostics(rows, findings).collect()}
    assert fixed == {0: "Keep as-is", 1: "new new . ", 2: "use b$r here $1"}
    assert diagnostics.tone_flags(replies_df).first().added_hype == ["industry-leading"]


def test_check_and_fix(spark):
    rows = [
        "unlock the next wave of growth", "[li-1] Increase revenue.", "Seamless deployment across regions",
        "Our state-of-the-art solution", "高性能、低コスト。",
    ]
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(rows)], "batch_id string, index long, text string")
    from twinscript import rules

    tables = (
        matching.dict_table(spark, {"state-of-the-art": "advanced"}, "phrase", "suggested"),
        matching.dict_table(spark, rules.CHECKED_PUNCTUATION, "original", "correct"),
        spark.createDataFrame([("導入", "Implementation")], "term string, expected string"),
        matching.alternatives_table(spark),
    )
    inline = {r["index"]: r.fixed for r in diagnostics.check_and_fix(df, *tables).collect()}
    joined = {r["index"]: r.fixed for r in diagnostics.check_and_fix(df, *tables, inline=0).collect()}
    assert inline == joined == {
        0: "Unlock the Next Wave of Growth", 1: "[li-1] Increase revenue", 2: "Seamless Implementation Across Regions",
        3: "Our advanced Solution", 4: "高性能, 低コスト. ",
    }


def test_gate_reasons(spark):
    def issues(*rows):
        return spark.createDataFrame([("d", c, "s", 0, t, "", "") for c, t in rows],
                                     "deck_id string, category string, slide string, idx long, issue_type string, description string, suggested_fix string")

    gate = lambda df, **kw: tuple(audits.quality_gate(df, **kw).first())[1:]
    assert gate(issues(("length_violations", "title_too_long"))) == (1, True, "Style audit passed: 1 issues found")
    assert gate(issues(("length_violations", "x")), max_issues=0) == (1, False, "Too many style issues: 1 (max allowed: 0)")
    assert gate(issues(("japanese_residual", "x")))[2] == "Critical issues found in japanese_residual: 1 issues"
    tags = issues(("formatting_tag_issues", "unbalanced_tags"))
    assert gate(tags, critical=[])[2] == "Critical issues found in unbalanced_tags: 1 issues"
    decks = spark.createDataFrame([("e",)], "deck_id string")
    assert audits.quality_gate(tags, decks=decks).first()["passed"]


def test_model_replies(spark):
    rows = [
        (0, '```json\n["a", "b"]\n```', 2), (1, 'Sure [1]: ["x \\"]", "y"] end', 2), (2, "no array", 1), (3, '["a"]', 2),
        (4, '["a", "b", "c"]', 2), (5, '[1, true]', 2), (6, '"[not]" [["p"], "q"]', 2), (7, '["a"]', 0),
        (8, '["a"] or ["b", "c"]', 2), (9, '["a", null]', 2), (10, '[' + ", ".join(['"w\\\\"'] * 20000) + "]", 20000),
    ]
    df = spark.createDataFrame(rows, "i int, reply string, expected_len int")
    got = {r.i: r["items"] for r in replies.parse_model_array(df).collect()}
    assert got == {
        0: ["a", "b"], 1: ['x "]', "y"], 2: None, 3: None, 4: ["a", "b"], 5: ["1", "True"], 6: ["['p']", "q"], 7: ["a"],
        8: ["b", "c"], 9: ["a", "None"], 10: ["w\\"] * 20000,
    }


def test_worklist_and_gate(spark):
    rows = spark.createDataFrame([("d", "s2", 0, "", "日"), ("d", "s1", 5, "", "日"), ("d", "s1", 1, "", "ok")], ROW)
    (item,) = residual.residual_worklist(residual.residual_locations(rows)).collect()
    assert (item.jp_text, item.slide_example, item.n_uses) == ("日", "s1", 2)
    by_slide = residual.before_after_of_pairs(rows).select("deck_id", "part_name", F.col("n_after").alias("n_chars"))
    assert residual.residual_gate(by_slide, 1).first()["passed"] is False
    assert residual.residual_gate(by_slide, 2).first()["passed"] is True


def test_translate_corpus(spark, segments, tm):
    glossary = spark.createDataFrame([("東京", "Tokyo")], "term string, expected string")
    calls = spark.sparkContext.accumulator(0)

    def translate(texts):
        calls.add(1)
        return [{"東京 ⟦URL_1⟧": "Tokyo ⟦URL_1⟧", "大阪": "Osaka city with a long explanation; and more"}[t] for t in texts]

    out = flows.translate_corpus(segments, tm, translate, glossary)
    got = {(r.deck_id, r.slide, r.idx): r.tgt for r in out.bilingual.collect()}
    assert got["d1", "s2", 0] == "Tokyo https://a.b/1"
    assert got["d2", "s1", 1] == "Osaka city with a long explanation; (detail → Notes)"
    assert [tuple(r) for r in out.notes.collect()] == [("d2", "s1", "Additional details: and more")]
    # Both decks ask once, and reading three results did not ask again.
    out.audit.count()
    assert calls.value == 2


def test_style_audit_flow(spark):
    rows = spark.createDataFrame([("d", "s", 0, "x", "A Fine Title"), ("e", "s", 0, "x", "bad [b]title")], ROW)
    out = flows.style_audit(rows)
    assert {r.deck_id: r.passed for r in out.gate.collect()} == {"d": True, "e": False}
    assert {r.category for r in out.counts.collect()} == {None, "capitalization_issues", "formatting_tag_issues"}


def test_style_audit_checks_rows_once(spark):
    rows = spark.createDataFrame([("d", "s", 0, "x", "A Fine Title"), ("e", "s", 0, "x", "bad [b]title")], ROW)
    out = flows.style_audit(rows)
    written = set(out.issues.inputFiles())
    assert written and written == set(out.counts.inputFiles()) == set(out.gate.inputFiles())


def test_exact_matches_keep_null_texts(spark):
    segments = spark.createDataFrame(
        [("d", "p", 0, "日本"), ("d", "p", 1, None), ("d", "p", 2, "plain"), (None, None, 3, None)],
        "deck_id string, part_name string, para_idx int, text string",
    )
    tm = spark.createDataFrame([("日本", "Japan"), ("plain", "no"), (None, "x")], "src string, tgt string")
    got = {r["para_idx"]: (r["new_text"], r["changed"]) for r in memory.apply_tm_exact(segments, tm).collect()}
    assert got == {0: ("Japan", True), 1: (None, False), 2: ("plain", False), 3: (None, False)}


def test_literal_patterns(spark):
    from pyspark.sql import functions as F

    from twinscript.functions.casing import quoted

    texts = [r"a\Eb", "x.y*", "(名) $1", "\\Q"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[0] for r in rows.select(F.call_function("rlike", F.col("t"), F.concat(F.lit("(?iU)^"), quoted(F.col("t")), F.lit("$")))).collect())


def test_deeply_nested_reply_is_no_array(spark):
    from twinscript.operators.replies import parse_model_array

    df = spark.createDataFrame([("x " + "[" * 100_000, 1), ('x ["a"]', 1)], "reply string, expected_len int")
    assert sorted((r["items"] or [] for r in parse_model_array(df).collect())) == [[], ["a"]]


def test_a_failed_batch_stays_missing(spark):
    """Other batches go on, the failed one's sources keep their text and are asked again."""
    rows = [("d1", "s1", i, f"日{i}") for i in range(4)] + [("d2", "s1", 0, "本")]
    segments = spark.createDataFrame([(d, "slide", p, 1, i, t) for d, p, i, t in rows], "deck_id string, part_kind string, part_name string, part_no long, para_idx long, text string")
    tm = spark.createDataFrame([], "src string, tgt string")
    glossary = spark.createDataFrame([], "term string, expected string")

    def translate(texts):
        if any("本" in t for t in texts):
            raise RuntimeError("no answer")
        return [f"day {t[-7:-1]}" for t in texts]

    from unittest import mock

    with mock.patch("time.sleep"):
        out = flows.translate_corpus(segments, tm, translate, glossary, batch=2)
    got = {r.src: r.tgt for r in out.bilingual.collect()}
    assert got["本"] == "本" and all(got[f"日{i}"].startswith("day") for i in range(4))
    assert {r.src for r in out.tm.collect()} == {f"日{i}" for i in range(4)}
    assert [r.src for r in memory.missing_sources(segments, out.tm).collect()] == ["本"]


def test_titles_have_their_own_limit(spark):
    from twinscript.functions.text import classify_segment_kind

    segments = spark.createDataFrame([("d", "slide", "p", 1, 0, "日本の首都")], "deck_id string, part_kind string, part_name string, part_no long, para_idx long, text string")
    empty = spark.createDataFrame([], "src string, tgt string"), spark.createDataFrame([], "term string, expected string")
    answer = "The City"  # 8 letters for 5: over the limit of bullets, within that of titles
    plain = flows.translate_corpus(segments, empty[0], lambda texts: [answer] * len(texts), empty[1])
    kinds = flows.translate_corpus(segments, empty[0], lambda texts: [answer] * len(texts), empty[1], kind=classify_segment_kind)
    assert kinds.bilingual.first().tgt == answer != plain.bilingual.first().tgt


def test_masking_texts_that_hold_placeholders(spark):
    from twinscript.functions.masking import mask_fragile, unmask_fragile
    from twinscript.operators.lengths import mask_round_trip_check

    texts = ["see ⟦URL_1⟧ and https://a.b/2 on 12", "⟦NUM_3⟧ 4 5", "⟦NUM_99999999999⟧ 7", "⟦CODE_2⟧ AB12 ⟦URL_1⟧", "https://x/⟦NUM_1⟧ 3", "⟦URL_1", "plain 1"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", mask_fragile(F.col("text")).alias("m")).select("text", "m.*", unmask_fragile(F.col("m.masked"), F.col("m.marks")).alias("back")).collect()
    assert all(r.back == r.text for r in rows)
    assert rows[0].masked == "see ⟦URL_1⟧ and ⟦URL_2⟧ on ⟦NUM_2⟧" and rows[6].masked == "plain ⟦NUM_1⟧"
    assert not set(rows[1].marks) & {"⟦NUM_3⟧"}
    assert mask_round_trip_check(df).count() == 0
    lost = mask_round_trip_check(df, lambda masked: F.replace(masked, F.lit("⟦URL_1⟧"), F.lit("")))
    assert {r.text for r in lost.collect()} == {texts[0], texts[3]}


def test_format_counts_stay_small(spark):
    from twinscript.operators import decks

    schema = "deck_id string, part_name string, record string, is_title boolean, font_family string, font_size int, margins string, line_spacing string"
    runs = spark.range(30000).select(
        F.lit("d").alias("deck_id"), F.lit("p").alias("part_name"), F.lit("run").alias("record"), F.lit(None).cast("boolean").alias("is_title"),
        F.when(F.col("id") % 2 == 0, "Arial").alias("font_family"), (F.col("id") % 3).cast("int").alias("font_size"),
        F.lit(None).cast("string").alias("margins"), F.lit(None).cast("string").alias("line_spacing"),
    )
    runs = runs.unionByName(spark.createDataFrame([("d", "p", "frame", True, None, None, "m", None), ("d", "p", "frame", None, None, None, None, None)], schema))
    assert decks.format_counts(runs).count() == 8
    row = decks.format_stats(runs).first()
    assert (row.text_frames, row.title_frames, row.body_frames) == (2, 1, 0)
    assert row.font_sizes == [0] * 10000 + [1] * 10000 + [2] * 10000 and row.font_families == ["Arial"] and row.margin_settings == ["m"]


def test_a_filled_worklist_goes_back_into_the_memory(spark, tmp_path):
    from twinscript.sources import files

    rows = [("日", "sun"), ("日", "day"), ("日", "day"), ("月", "m"), ("月", "l"), ("本", " "), ("木", None), ("x木", "x木"), ("火", "火 fire"), (None, "x"), ("水", "say \"water\", 2\nlines")]
    filled = spark.createDataFrame(rows, "jp_text string, proposed_en string").withColumn("slide_example", F.lit("s")).withColumn("deck_example", F.lit("d"))
    path = str(tmp_path / "list")
    files.write_worklist(filled, path)
    patch = residual.residual_patch(files.read_worklist(spark, path))
    assert {r.src: r.tgt for r in patch.collect()} == {"日": "day", "月": "l", "水": 'say "water", 2\nlines'}
    tm = spark.createDataFrame([("a", "日"), ("日", "old"), ("b", "fine"), ("c", None)], "src string, tgt string")
    assert {r.src: r.tgt for r in residual.patch_memory(tm, patch).collect()} == {
        "a": "day", "b": "fine", "c": None, "日": "day", "月": "l", "水": 'say "water", 2\nlines'
    }
    pairs = spark.createDataFrame([("d", "日"), ("d", "日"), ("e", None), (None, "x")], "deck_id string, tgt string")
    got = sorted(map(tuple, residual.patch_bilingual(pairs, patch).collect()), key=repr)
    assert got == sorted([("d", "day", True), ("d", "day", True), ("e", None, False), (None, "x", False)], key=repr)


def test_totals_are_told_from_nameless_slides(spark):
    rows = [(None, "s", "日"), ("d", None, "日本"), ("d", "t", "x")]
    got = residual.script_chars_total(spark.createDataFrame(rows, "deck_id string, part_name string, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(
        [(None, "s", 1, 0), ("d", None, 2, 0), ("d", "t", 0, 0), (None, None, 1, 1), ("d", None, 2, 1), (None, None, 3, 3)], key=repr
    )


def test_slide_ranges_keep_notes_by_name_too(spark):
    from twinscript.operators.segments import filter_slide_range

    names = ["ppt/slides/slide3.xml", "ppt/notesSlides/notesSlide3.xml", "ppt/slides/slide9.xml", "other"]
    df = spark.createDataFrame([(n,) for n in names], "part_name string")
    assert {r[0] for r in filter_slide_range(df, "2-4").collect()} == set(names[:2])


def test_only_rows_with_script_meet_the_patch(spark):
    """The others are not shuffled, unless the patch holds a text without script."""
    rows = spark.createDataFrame([("d", "s", i, "x", t) for i, t in enumerate(["日本", "plain", None, "日"])], ROW)
    patch = spark.createDataFrame([("日本", "Japan")], "src string, tgt string")
    out = residual.patch_bilingual(rows, patch)
    joined = out._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert "RLIKE" in joined.split("LogicalRDD")[0]
    assert sorted((r.idx, r.tgt, r.patched) for r in out.collect()) == [(0, "Japan", True), (1, "plain", False), (2, None, False), (3, "日", False)]
    more = patch.unionByName(spark.createDataFrame([("plain", "better")], "src string, tgt string"))
    got = sorted((r.idx, r.tgt, r.patched) for r in residual.patch_bilingual(rows, more).collect())
    assert got == [(0, "Japan", True), (1, "better", True), (2, None, False), (3, "日", False)]


def test_many_batches_cross_at_a_time(spark):
    """Each batch is one call, in order; a failed one keeps its texts; a null deck is a deck."""
    batches = spark.range(0, 1200, 1, 3).selectExpr(
        "if((id div 4) % 3 > 0, 'd', null) AS deck_id", "id div 4 AS batch_id", "3 - id % 4 AS pos_in_batch", "concat('日', id div 4, ' ', 3 - id % 4) AS src"
    )

    def translate(texts):
        assert len(texts) == 4
        return [f"{i} {t}" for i, t in enumerate(texts)]

    out = memory.translate_missing(batches, translate, backoff=0.0)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.batch_id, r.pos_in_batch, r.deck_id, r.src, r.tgt, r.translated) for r in out.collect())
    assert got == [(b, p, "d" if b % 3 else None, f"日{b} {p}", f"{p} 日{b} {p}", True) for b in range(300) for p in range(4)]
    got = [(r.src, r.tgt, r.translated) for r in memory.translate_missing(batches, lambda texts: texts[:3], backoff=0.0).collect()]
    assert len(got) == 1200 and all(tgt == src and not done for src, tgt, done in got)
