"""Translation memory, batches, run comparison."""

from pyspark.sql import functions as F

from twinscript.catalog import sql as q
from twinscript.catalog import workloads as w
from twinscript.catalog.column_queries import TERMS_KEPT, same_counts, spill_sql
from twinscript.catalog.registry import query
from twinscript.functions.script import has_script
from twinscript.operators import memory as m
from twinscript.operators import runs
from twinscript.operators.replies import parse_model_array
from twinscript.plans import flows
from twinscript.session import scratch_path, staged
from twinscript.sources import files


@query(
    "lookup_translations",
    q.using(
        "SELECT deck_id, part_name AS slide, para_idx AS idx, text AS src, coalesce(tgt, text) AS tgt "
        "FROM segments LEFT JOIN tm ON text = src"
    ),
)
def lookup_translations(spark, sf_dir):
    return m.lookup_translations(w.segments(spark, sf_dir), w.memory(spark, sf_dir))


@query(
    "apply_tm_exact",
    q.using(
        f"SELECT deck_id, part_name, para_idx, CASE WHEN hit THEN tgt ELSE text END AS new_text, hit AS changed FROM ("
        f"SELECT *, coalesce(tgt <> '' AND {q.has('text')}, false) AS hit FROM segments LEFT JOIN tm ON text = src)"
    ),
)
def apply_tm_exact(spark, sf_dir):
    return m.apply_tm_exact(w.segments(spark, sf_dir), w.memory(spark, sf_dir)).select(
        "deck_id", "part_name", "para_idx", "new_text", "changed"
    )


@query(
    "apply_tm_exact_any_source",
    q.using(
        "SELECT deck_id, part_name, para_idx, coalesce(tgt, text) AS new_text, src IS NOT NULL AS changed "
        "FROM segments LEFT JOIN tm ON text = src"
    ),
)
def apply_tm_exact_any_source(spark, sf_dir):
    return m.apply_tm_exact(w.segments(spark, sf_dir), w.memory(spark, sf_dir), require_script=False).select(
        "deck_id", "part_name", "para_idx", "new_text", "changed"
    )


_DISTINCT = (
    "sources AS (SELECT deck_id, text AS src, first(part_name ORDER BY part_name, para_idx) AS first_part, "
    "first(para_idx ORDER BY part_name, para_idx) AS first_idx, count(*) AS n_uses "
    f"FROM segments WHERE {q.has('text')} GROUP BY deck_id, text)"
)
_MISSING = "missing AS (SELECT * FROM sources s WHERE NOT EXISTS (SELECT 1 FROM tm t WHERE t.src = s.src AND t.tgt <> t.src))"
_BATCHES = (
    "batches AS (SELECT *, (rn - 1) // 40 AS batch_id, (rn - 1) % 40 AS pos_in_batch FROM ("
    "SELECT *, row_number() OVER (PARTITION BY deck_id ORDER BY first_part, first_idx) AS rn FROM missing))"
)


@query("distinct_sources", q.using("SELECT * FROM sources", _DISTINCT))
def distinct_sources(spark, sf_dir):
    return m.distinct_sources(w.segments(spark, sf_dir))


def _missing(spark, sf_dir, rule="identity"):
    return m.missing_sources(w.segments(spark, sf_dir), w.memory(spark, sf_dir), rule)


@query("missing_sources", q.using("SELECT * FROM missing", _DISTINCT, _MISSING))
def missing_sources(spark, sf_dir):
    return _missing(spark, sf_dir)


@query(
    "missing_sources_clean_rule",
    q.using(
        "SELECT * FROM sources s WHERE NOT EXISTS (SELECT 1 FROM tm t WHERE t.src = s.src AND t.tgt <> t.src "
        f"AND NOT {q.has('t.tgt')})",
        _DISTINCT,
    ),
)
def missing_sources_clean_rule(spark, sf_dir):
    return _missing(spark, sf_dir, "clean")


@query(
    "merge_tm",
    q.using(
        "SELECT src, coalesce(u.tgt, t.tgt) AS tgt FROM tm t FULL JOIN "
        f"(SELECT DISTINCT text AS src, 'new ' || text AS tgt FROM segments WHERE {q.has('text')} AND lang = 'es') u USING (src)"
    ),
)
def merge_tm(spark, sf_dir):
    updates = (
        w.segments(spark, sf_dir)
        .filter(has_script(F.col("text")) & (F.col("lang") == "es"))
        .select(F.col("text").alias("src"), F.concat(F.lit("new "), "text").alias("tgt"))
    )
    return m.merge_tm(w.memory(spark, sf_dir), updates)


@query("scrub_tm", q.using(f"SELECT * FROM tm WHERE tgt <> src AND NOT {q.has('tgt')}"))
def scrub_tm(spark, sf_dir):
    return m.scrub_tm(w.memory(spark, sf_dir))


@query(
    "assign_batches",
    q.using("SELECT deck_id, src, batch_id, pos_in_batch FROM batches", _DISTINCT, _MISSING, _BATCHES),
)
def assign_batches(spark, sf_dir):
    return m.assign_batches(_missing(spark, sf_dir)).select("deck_id", "src", "batch_id", "pos_in_batch")


@query(
    "translate_missing",
    q.using("SELECT deck_id, batch_id, pos_in_batch, src, 'EN ' || src AS tgt FROM batches", _DISTINCT, _MISSING, _BATCHES),
)
def translate_missing(spark, sf_dir):
    batches = m.assign_batches(_missing(spark, sf_dir))
    out = m.translate_missing(batches, lambda texts: [f"EN {t}" for t in texts])
    return out.select("deck_id", "batch_id", "pos_in_batch", "src", "tgt")


_ANSWER_STUB, _ANSWER_NOTES = spill_sql("t", "'bullet'")
_ANSWERS = (
    "answers AS (SELECT src, CASE WHEN r <= 1.4::DOUBLE THEN t "
    f"WHEN ({same_counts('src', 'whole')}) AND {TERMS_KEPT} THEN stub ELSE t END AS text FROM ("
    "SELECT *, stub || ' ' || spill AS whole FROM ("
    f"SELECT *, {q.ratio('src', 't')} AS r, {_ANSWER_STUB} AS stub, {_ANSWER_NOTES} AS spill FROM "
    "(SELECT DISTINCT src, 'EN ' || src AS t FROM missing)))), "
    f"styled AS (SELECT src, CASE {q.kind('text')} WHEN 'title' THEN norm ELSE {q.bullet_fragment('norm', '.;:。；：')} END AS new "
    f"FROM (SELECT *, {q.normalize_mechanics('text')} AS norm FROM answers))"
)


@query(
    "translate_corpus",
    q.using(
        "SELECT deck_id, part_name AS slide, para_idx AS idx, text AS src, coalesce(new, tgt, text) AS tgt "
        "FROM segments s LEFT JOIN styled n ON s.text = n.src LEFT JOIN tm m ON s.text = m.src",
        _DISTINCT, _MISSING, _ANSWERS,
    ),
)
def translate_corpus(spark, sf_dir):
    """The whole flow: gaps, batches, calls, length and style rules, memory, lookup. The memory is read twice, so it is written."""
    out = flows.translate_corpus(
        w.segments(spark, sf_dir), staged(w.memory(spark, sf_dir), "memory"), lambda texts: [f"EN {t}" for t in texts], w.glossary(spark)
    )
    return out.bilingual


@query("clean_memory", q.using(f"SELECT src, tgt FROM tm WHERE tgt <> src AND NOT {q.has('tgt')}"))
def clean_memory(spark, sf_dir):
    """The flow over a stored memory: a new version without entries that need another translation."""
    path = scratch_path(spark, "tm")
    files.write_tm(w.memory(spark, sf_dir), path, "001")
    return flows.clean_memory(spark, path, "001", "002")


_VOTES = "votes AS (SELECT src, tgt, count(*) AS votes FROM tm_runs GROUP BY ALL)"


@query(
    "run_disagreement",
    q.using(
        "SELECT * FROM (SELECT src, count(*) OVER (PARTITION BY src) AS n_variants, tgt, votes FROM votes) WHERE n_variants > 1",
        _VOTES,
    ),
)
def run_disagreement(spark, sf_dir):
    return runs.run_disagreement(w.memory_runs(spark, sf_dir))


@query(
    "run_disagreement_totals",
    q.using(
        "SELECT count(*) AS unique_sources, count(*) FILTER (n > 1) AS differing_sources, max(n) AS most_variants "
        "FROM (SELECT src, count(*) AS n FROM votes GROUP BY src)",
        _VOTES,
    ),
)
def run_disagreement_totals(spark, sf_dir):
    return runs.run_disagreement_totals(w.memory_runs(spark, sf_dir))


@query(
    "consensus_merge",
    q.using("SELECT src, first(tgt ORDER BY votes DESC, tgt) AS tgt, max(votes) AS votes FROM votes GROUP BY src", _VOTES),
)
def consensus_merge(spark, sf_dir):
    return runs.consensus_merge(w.memory_runs(spark, sf_dir))


def _audits(spark, sf_dir):
    """Each order is a deck audit of the run its clerk stands for."""
    orders = w.table(spark, sf_dir, "lineitem")
    return orders.groupBy(F.col("l_suppkey").alias("run_id"), F.col("l_orderkey").alias("deck_id")).agg(
        F.sum("l_linenumber").cast("long").alias("jp_chars_before"),
        F.count("*").alias("jp_chars_after"),
        F.lit(1).cast("long").alias("api_calls"),
    )


_AUDITS = (
    "audits AS (SELECT l_suppkey AS run_id, CAST(sum(l_linenumber) AS BIGINT) AS jp_chars_before, "
    "count(*) AS jp_chars_after, count(DISTINCT l_orderkey) AS api_calls FROM lineitem GROUP BY l_suppkey)"
)


@query("run_totals", q.using("SELECT * FROM audits", _AUDITS))
def run_totals(spark, sf_dir):
    return runs.run_totals(_audits(spark, sf_dir))


@query(
    "best_run",
    q.using("SELECT run_id, jp_chars_after FROM audits ORDER BY jp_chars_after, run_id LIMIT 1", _AUDITS),
)
def best_run(spark, sf_dir):
    return runs.best_run(runs.run_totals(_audits(spark, sf_dir)))


def _replies(spark, sf_dir):
    """A reply per turn: the words as a JSON array, bare, fenced or inside a sentence, by role."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    array = F.to_json(words)
    reply = (
        F.when(F.col("role") == "user", array)
        .when(F.col("role") == "system", F.concat(F.lit("```json\n"), array, F.lit("\n```")))
        .otherwise(F.concat(F.lit('Here "is [not]" it [1]: '), array, F.lit(" done")))
    )
    return w.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", reply.alias("reply"), F.greatest(F.size(words) - 1, F.lit(2)).alias("expected_len")
    )


@query(
    "parse_model_array",
    "SELECT conv_id, turn, CASE WHEN len(ws) >= n THEN array_to_string(ws[1:n], '|') END AS items FROM ("
    "SELECT *, greatest(len(ws) - 1, 2) AS n FROM (SELECT conv_id, turn, "
    "list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM conversations))",
)
def model_array(spark, sf_dir):
    parsed = parse_model_array(_replies(spark, sf_dir))
    return parsed.select("conv_id", "turn", F.array_join("items", "|").alias("items"))
