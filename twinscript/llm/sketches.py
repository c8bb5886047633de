"""Document fingerprints: the smallest hashes of a text's shingles.

A sketch is the ``size`` smallest distinct hashes of the shingles of five words. The sketch of a union is the
smallest of both sketches' hashes, so sketches of parts merge, and a text, a source or a corpus may be sketched in
any number of parts. From sketches alone follow how much two sets resemble each other, how much of one is in the
other, and how many distinct shingles there are. A text of ``size`` shingles or fewer is sketched whole and all
three are exact (but for equal hashes, whose chance is negligible).

Hashes are taken over the Arrow buffer of a block of texts at once: words by a rolling hash of their bytes,
shingles by a rolling hash of their words.
"""

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from twinscript.llm.packing import blocks
from twinscript.llm.repeats import Powers, Rolling
from twinscript.llm.tables import text_of

SHINGLE, SIZE = 5, 128
HASH_BYTES = 6
SPACE = 1 << (8 * HASH_BYTES)  # hashes are whole numbers below it
BLOCK_CHARS = 4_000_000
RANGE_BYTES = 64 * 2**20  # of text in a range of doc_ids

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_hashes(texts: list[bytes], powers: Powers, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes below SPACE of all shingles, in order, and their number per text.

    Words are runs of other than white space. Fewer words than a shingle are one shingle; no word is none.
    """
    data = np.frombuffer(b" ".join(texts), np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    word = ~BLANK[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = Rolling(data.astype(np.uint64) + np.uint64(1), powers).of(starts, stops)
    n_words = np.diff(np.searchsorted(starts, cuts))
    ends = np.cumsum(n_words)
    sizes = np.where(n_words > shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = np.repeat(ends - n_words, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.minimum(first + shingle, np.repeat(ends, sizes))
    return Rolling(words, powers).of(first, last) >> np.uint64(64 - 8 * HASH_BYTES), sizes


def bottom(hashes: np.ndarray, sizes: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """The ``size`` smallest distinct hashes of each text, ascending."""
    out, at = [], 0
    for n in sizes.tolist():
        own = hashes[at : at + n]
        at += n
        if n > 4 * size:
            # Hardly more than ``size`` of the hashes are needed; repeats may ask for all of them.
            few = np.unique(np.partition(own, 2 * size)[: 2 * size])
            own = few if len(few) >= size else np.unique(own)
        else:
            own = np.unique(own)
        out.append(own[:size])
    return out


def text_sketches(texts: list[str], powers: Powers, shingle: int = SHINGLE, size: int = SIZE) -> list[np.ndarray]:
    return bottom(*shingle_hashes([t.encode("utf-8", "surrogatepass") for t in texts], powers, shingle), size)


def written(sketch: np.ndarray) -> str:
    """A sketch as text: eight letters, digits, ``-`` or ``_`` a hash, in ascending order of the hashes."""
    return base64.urlsafe_b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()).decode()


def estimates(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> tuple[float, float, float]:
    """Resemblance of two sets, containment of the first in the second, and distinct hashes of their union.

    Two empty sets resemble each other wholly; an empty set is contained in every set.
    """
    union = np.union1d(a, b)
    whole = len(a) < size and len(b) < size
    if not whole:
        union = union[:size]
    common = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    left = int(np.isin(union, a, assume_unique=True).sum())
    resemblance = float(common.sum()) / len(union) if len(union) else 1.0
    containment = float(common.sum()) / left if left else float(not len(a))
    return resemblance, containment, distinct(union, whole, size)


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The first of ``estimates``, from one sort."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    twice = both[1:] == both[:-1]
    if len(a) < size and len(b) < size:
        common = int(twice.sum())
        return common / (len(both) - common)
    last = both[np.concatenate([[True], ~twice])][size - 1]
    return int((twice & (both[1:] <= last)).sum()) / size


def distinct(sketch: np.ndarray, whole: bool, size: int = SIZE) -> float:
    """Distinct hashes that a sketch stands for: counted, or told from how small its largest hash is."""
    return float(len(sketch)) if whole or len(sketch) < size else (size - 1) * SPACE / (float(sketch[-1]) + 1)


def sketch_texts(docs: DataFrame, keep: list[str], shingle: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``sketch``, the ascending smallest hashes of its text."""
    at = len(keep)

    def hash_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for lo, hi in blocks(texts, BLOCK_CHARS):
                lists = pa.array([s.astype(np.int64) for s in text_sketches(texts[lo:hi], powers, shingle, size)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(at)], lists], [*keep, "sketch"])

    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return docs.select(*keep, text_of().alias("_t")).mapInArrow(hash_batches, f"{kinds}sketch array<long>")


def merged(sketches: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """One sketch for each group of ``by``, whatever its number of parts.

    The rank filter works below the shuffle too: no task hands on more than ``size`` hashes a group.
    """
    hashes = sketches.select(*by, F.explode_outer("sketch").alias("_h"))
    smallest = Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last())
    few = hashes.withColumn("_k", F.dense_rank().over(smallest)).filter(F.col("_k") <= size)
    return few.groupBy(*by).agg(F.array_sort(F.collect_set("_h")).alias("sketch"))


def compared(a: Column, b: Column, size: int = SIZE) -> tuple[Column, Column, Column]:
    """``estimates`` of two sketch columns as columns, without Python."""
    both = F.array_sort(F.array_union(a, b))
    whole = (F.size(a) < size) & (F.size(b) < size)
    union = F.when(whole, both).otherwise(F.slice(both, 1, size))
    common, left = F.size(F.array_intersect(F.array_intersect(a, b), union)), F.size(F.array_intersect(union, a))
    alike = F.when(F.size(union) > 0, common / F.greatest(F.size(union), F.lit(1))).otherwise(F.lit(1.0))
    inside = F.when(left > 0, common / F.greatest(left, F.lit(1))).otherwise((F.size(a) == 0).cast("double"))
    return alike, inside, F.when(whole, F.size(union).cast("double")).otherwise(distinct_shingles(union, size))


def distinct_shingles(sketch: Column, size: int = SIZE) -> Column:
    """The number of distinct shingles a sketch stands for."""
    largest = F.coalesce(F.try_element_at(sketch, F.lit(-1)), F.lit(0)).cast("double")
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise((size - 1) * float(SPACE) / (largest + 1))


def _id_ranges(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest id of disjoint ranges with about RANGE_BYTES of text each, ascending.

    Only ids and lengths are read, and two numbers a range come to the driver. All rows of one id are in one range.
    """
    total = docs.agg(F.sum(F.octet_length(text_of()).cast("long"))).first()[0] or 0
    n = max(-(-total // RANGE_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select("_order").repartitionByRange(n, F.desc("_order")).groupBy(F.spark_partition_id().alias("_p"))
    rows = ranged.agg(F.min("_order").alias("least"), F.max("_order").alias("most")).collect()
    pairs = np.array(sorted((r["least"], r["most"]) for r in rows), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def fingerprints_beside_next(docs: DataFrame, shingle: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    A document's edited text has its last half (``floor(n_chars / 2)`` code points) replaced by the first as many code
    points of the next document in descending doc_id, or by all it has; after the last document comes the first.
    ``near_edited`` and ``near_next`` are the resemblance to the edited and to the next text, told from sketches.

    Texts move once, into ranges of ids; the document that a range's last one needs is sent to that range too.

    doc_id is a whole number; null ids come last. Documents of one id are ordered by their texts, so repeated rows
    follow each other. A null text counts as empty; texts without a word have the empty fingerprint, which resembles
    itself by 1 and others by 0. Texts may be of any length. An empty table gives an empty result. Other columns are
    not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_order"), text_of().alias("text"))
    least, most = _id_ranges(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    @F.pandas_udf("array<int>")
    def ranges_of(ids: pd.Series) -> pd.Series:
        """The range of an id; the one above it too if its last document needs this id's."""
        ids = ids.to_numpy()
        at = np.searchsorted(least, ids, side="right") - 1
        above = (at + 1) % len(least)
        return pd.Series([[r, a] if top else [r] for r, a, top in zip(at.tolist(), above.tolist(), (ids == most[at]).tolist())])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held = None  # the last row of what came before: range, whether borrowed, id, text, sketch

        def known(batch):
            nonlocal held
            texts = batch.column(3).to_pylist()
            for lo, hi in blocks(texts, BLOCK_CHARS):
                sketches = text_sketches(texts[lo:hi], powers, shingle, size)
                part = zip(*(batch.column(k).slice(lo, hi - lo).to_pylist() for k in range(3)), texts[lo:hi], sketches)
                rows = [held, *part] if held is not None else [*part]
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
                if pairs:
                    yield pairs

        for batch in batches:
            for pairs in known(batch):
                edited = []
                for (*_, text, _), (*_, after, _) in pairs:
                    half = len(text) // 2
                    edited.append(text[: len(text) - half] + after[:half])
                changed = text_sketches(edited, powers, shingle, size)
                columns = [
                    pa.array([a[2] for a, _ in pairs], id_type),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([written(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([written(c) for c in changed], pa.string()),
                    pa.array([resemblance(a[4], c, size) for (a, _), c in zip(pairs, changed)], pa.float64()),
                    pa.array([resemblance(a[4], b[4], size) for a, b in pairs], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    if not len(least):
        least = most = np.zeros(1, np.int64)
    placed = rows.select(F.posexplode(ranges_of("_order")).alias("_borrowed", "_range"), "doc_id", "_order", "text")
    laid = placed.repartition(len(least), "_range").sortWithinPartitions("_range", "_borrowed", F.desc("_order"), F.asc_nulls_last("doc_id"), "text")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return laid.select("_range", F.col("_borrowed") > 0, "doc_id", "text").mapInArrow(measure, schema)
