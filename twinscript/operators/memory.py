"""The translation memory: lookup, gaps, overlay, cleaning.

A memory (``src, tgt``) has one row per source; :func:`merge_tm` makes one out of
several tables. It may be as large as the corpus. Lookups are equi joins on the text;
a memory that turns out small is broadcast, and the rows of a text that holds a
large share of them are split over tasks (:mod:`joins`).
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.functions.masking import mask_fragile, unmask_fragile
from twinscript.functions.script import has_script, is_identity_entry, is_unusable_entry
from twinscript.operators.joins import join_hot
from twinscript.operators.ordering import number_rows


BATCHES_AT_ONCE = 64  # whose texts are Python values


def lookup_translations(segments: DataFrame, tm: DataFrame) -> DataFrame:
    """Each paragraph with its target, or with its own text when the memory has none."""
    entries = tm.select(F.col("src").alias("text"), "tgt")
    return join_hot(segments, entries, "text", "left").select(
        "deck_id",
        F.col("part_name").alias("slide"),
        F.col("para_idx").alias("idx"),
        F.col("text").alias("src"),
        F.coalesce("tgt", "text").alias("tgt"),
    )


def apply_tm_exact(segments: DataFrame, tm: DataFrame, require_script: bool = True) -> DataFrame:
    """Replace exact matches.

    By default an empty target and a source without source script do not count;
    ``require_script=False`` applies every hit.
    """
    hit = F.col("tgt").isNotNull()
    if not require_script:
        return _with_hits(join_hot(segments, tm.select(F.col("src").alias("text"), "tgt"), "text", "left"), hit)
    # Texts without source script, null ones included, cannot match. They have no key, and their place
    # spreads them over the tasks, so that the corpus is read once and none of them piles up.
    foreign = F.coalesce(has_script(F.col("text")), F.lit(False))
    keyed = segments.withColumns(
        {
            "_key": F.when(foreign, F.col("text")),
            "_hash": F.when(foreign, F.xxhash64("text")).otherwise(F.xxhash64("deck_id", "part_name", "para_idx")),
        }
    )
    usable = tm.filter((F.col("tgt") != "") & has_script(F.col("src")))
    entries = usable.select(F.xxhash64("src").alias("_hash"), F.col("src").alias("_key"), "tgt")
    return _with_hits(keyed.join(entries, ["_hash", "_key"], "left").drop("_hash", "_key"), hit)


def _with_hits(joined: DataFrame, hit: Column) -> DataFrame:
    return joined.withColumns(
        {"new_text": F.when(hit, F.col("tgt")).otherwise(F.col("text")), "changed": hit}
    ).drop("tgt")


def distinct_sources(segments: DataFrame, cls: str = rules.SCRIPT_ANY, by: list[str] | None = None) -> DataFrame:
    """Distinct texts with source script, where each first stands, and how often it is used."""
    by = ["deck_id"] if by is None else by
    return (
        segments.filter(has_script(F.col("text"), cls))
        .groupBy(*by, F.col("text").alias("src"))
        .agg(F.min(F.struct("part_name", "para_idx")).alias("at"), F.count("*").alias("n_uses"))
        .select(*by, "src", F.col("at.part_name").alias("first_part"), F.col("at.para_idx").alias("first_idx"), "n_uses")
    )


def usable_entries(tm: DataFrame, rule: str = "identity") -> DataFrame:
    """Entries worth reusing: not unchanged, and for ``clean`` without source script."""
    if rule == "identity":
        return tm.filter(F.col("tgt").isNotNull() & ~is_identity_entry(F.col("src"), F.col("tgt")))
    if rule == "clean":
        return tm.filter(~is_unusable_entry(F.col("src"), F.col("tgt")))
    raise ValueError("rule is 'identity' or 'clean'")


def scrub_tm(tm: DataFrame) -> DataFrame:
    """The memory without entries that need another translation."""
    return usable_entries(tm, "clean")


def missing_sources(segments: DataFrame, tm: DataFrame, rule: str = "identity") -> DataFrame:
    """Distinct texts the memory cannot serve; deduplicated before the join."""
    known = usable_entries(tm, rule).select("src")
    return join_hot(distinct_sources(segments), known, "src", "left_anti")


def merge_tm(tm: DataFrame, *updates: DataFrame) -> DataFrame:
    """Later tables win on the same source."""
    layers = [t.select("src", "tgt", F.lit(i).alias("layer")) for i, t in enumerate((tm, *updates))]
    merged = layers[0]
    for layer in layers[1:]:
        merged = merged.unionByName(layer)
    return (
        merged.groupBy("src")
        .agg(F.max(F.struct("layer", "tgt")).alias("last"))
        .select("src", F.col("last.tgt").alias("tgt"))
    )


def assign_batches(missing: DataFrame, batch: int = rules.TRANSLATE_BATCH) -> DataFrame:
    """Cut each deck's missing texts into requests of ``batch``, in reading order."""
    numbered = number_rows(missing, ["deck_id"], ["first_part", "first_idx"], "rn")
    return numbered.select(
        *missing.columns,
        F.floor((F.col("rn") - 1) / batch).cast("long").alias("batch_id"),
        ((F.col("rn") - 1) % batch).cast("long").alias("pos_in_batch"),
    )


def translate_missing(
    batches: DataFrame,
    translate: Callable[[list[str]], list[str]],
    tries: int = 3,
    backoff: float = 1.0,
    mask: bool = True,
) -> DataFrame:
    """Run a caller's ``list[str] -> list[str]`` on every batch.

    A batch that fails ``tries`` times keeps its sources. Links, numbers and codes
    are masked before the call and restored after it, outside Python.
    """
    # Only what the call needs crosses into Python: batch key, positions, both texts. A batch is one row,
    # so that many cross at a time; as groups of their own each would cost more than its texts.
    sent = F.col("src")
    if mask:
        sent = mask_fragile(sent)["masked"]
    prepared = batches.select("deck_id", "batch_id", F.struct("pos_in_batch", "src", sent.alias("sent")).alias("_text"))
    grouped = prepared.groupBy("deck_id", "batch_id").agg(F.array_sort(F.collect_list("_text")).alias("_texts"))
    requests = grouped.select("deck_id", "batch_id", *[F.col(f"_texts.{c}").alias(c) for c in ("pos_in_batch", "src", "sent")])

    def call(texts):
        import time

        for attempt in range(tries):
            try:
                got = list(translate(list(texts)))
                if len(got) >= len(texts):
                    return [str(t) for t in got[: len(texts)]], True
            except Exception:
                pass
            if attempt + 1 < tries:
                time.sleep(backoff * (1 + attempt))
        return texts, False

    def answered(tables):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in tables:
            for start in range(0, whole.num_rows, BATCHES_AT_ONCE):
                table = whole.slice(start, BATCHES_AT_ONCE)
                answers = [call(texts) for texts in table.column("sent").to_pylist()]
                sizes = [len(texts) for texts, _ in answers]
                of = pa.array(np.repeat(np.arange(table.num_rows), sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[table.column(c).take(of) for c in ("deck_id", "batch_id")],
                        *[pc.list_flatten(table.column(c)) for c in ("pos_in_batch", "src")],
                        pa.array([text for texts, _ in answers for text in texts], pa.string()),
                        pa.array(np.repeat([done for _, done in answers], sizes), pa.bool_()),
                    ],
                    ["deck_id", "batch_id", "pos_in_batch", "src", "answer", "translated"],
                )

    answers = requests.mapInArrow(
        answered, "deck_id string, batch_id long, pos_in_batch long, src string, answer string, translated boolean"
    )
    tgt: Column = F.col("answer")
    if mask:
        tgt = F.when(tgt.contains("⟦"), unmask_fragile(tgt, mask_fragile(F.col("src"))["marks"])).otherwise(tgt)
    return answers.select("deck_id", "batch_id", "pos_in_batch", "src", tgt.alias("tgt"), "translated")
