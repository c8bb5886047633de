"""Shared ground of the two exact substring operators: distinct texts, rolling hashes, who occurs twice.

Both operators run in passes over one table of distinct texts, bucketed by a content id, so
that later passes join small tables of positions to it without shuffling a text again.
"""

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.llm.tables import content_key, scratch_path, text_of
from twinscript.session import stage_table

STORE_BYTES = 128 * 2**20  # of text in a bucket
SEEN_KEYS = 200_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))
POSITION_BITS = np.uint64(32)


def content_id():
    """64 bits for joins; the full key beside it tells texts apart in the end."""
    return F.xxhash64(text_of())


def text_store(docs: DataFrame) -> DataFrame:
    """One row per distinct text: ``_id``, ``_key``, ``text`` and its number of ``copies``.

    Copies are counted where they are read before anything is shuffled, so a text that makes up
    a third of the corpus reaches its bucket as a row per task.
    """
    spark = docs.sparkSession

    def collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def counts() -> pa.RecordBatch:
            more = [(i, k, c) for k, (i, c) in seen.items() if c]
            columns = [pa.array([r[j] for r in more], t) for j, t in ((0, pa.int64()), (1, pa.binary()), (2, pa.int64()))]
            return pa.RecordBatch.from_arrays([columns[0], columns[1], pa.nulls(len(more), pa.string()), columns[2]], ["_id", "_key", "text", "n"])

        for batch in batches:
            fresh = np.zeros(len(batch), bool)
            for j, (i, k) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k in seen:
                    seen[k][1] += 1
                else:
                    seen[k] = [i, 0]
                    fresh[j] = True
            rows = batch.filter(pa.array(fresh))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.ones(len(rows), np.int64))], ["_id", "_key", "text", "n"])
            if len(seen) > SEEN_KEYS:
                yield counts()
                seen.clear()
        yield counts()

    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // STORE_BYTES))
    texts = docs.select(content_id().alias("_id"), content_key().alias("_key"), text_of().alias("text"))
    collapsed = texts.mapInArrow(collapse, "_id long, _key binary, text string, n long").repartition(buckets, "_id")
    distinct = collapsed.groupBy("_id", "_key").agg(F.max("text").alias("text"), F.sum("n").alias("copies"))
    name = f"twinscript_texts_{uuid.uuid4().hex}"
    path = scratch_path(spark, "texts")
    distinct.write.bucketBy(buckets, "_id").option("compression", "zstd").option("path", path).saveAsTable(name)
    return stage_table(spark, name, path)


def mix(x: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit values (the well-known one of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            n = max(n + 1, 1 << 20)
            grow = lambda f: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, f, np.uint64))])
            self.up, self.down = grow(MULTIPLIER), grow(INVERSE)
        return self.up, self.down


class Rolling:
    """Hashes of any ranges of one sequence of values, after one pass over it."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


def occurrence_rows(h: np.ndarray, check: np.ndarray | None, ids: np.ndarray, pos: np.ndarray, only_tell: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows to be met by ``found_elsewhere``: value ``h`` (and ``check``) at position ``pos`` of text ``ids``.

    Values that occur twice in this very block are settled here: their places travel apart from
    each other, and one row tells the other blocks of the value. So however common a value is,
    no more than a row per block meets at its hash. ``only_tell`` marks places that want no answer
    because all copies of their text are known to repeat; they count as occurring twice.
    """
    check = np.zeros(len(h), np.uint64) if check is None else check & np.uint64(0x7FFFFFFF)
    tell = np.zeros(len(h), bool) if only_tell is None else only_tell
    order = np.lexsort((check, h))
    h, check, ids, pos, tell = h[order], check[order], ids[order], pos[order], tell[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    size = np.bincount(group, 1 + tell)
    twice = size[group] > 1
    one, many, announce = ~twice, twice & ~tell, np.flatnonzero(new & twice)
    place = pos.astype(np.int64)
    packed = lambda c, p: ((c.astype(np.uint64) << POSITION_BITS).astype(np.int64)) | (p & 0xFFFFFFFF)
    rows_h = np.concatenate([h[one].view(np.int64), mix(ids[many].view(np.uint64) ^ place[many].astype(np.uint64)).view(np.int64), h[announce].view(np.int64)])
    rows_x = np.concatenate([packed(check[one], place[one]), packed(check[many], place[many]) | np.int64(-(2**63)), packed(check[announce], np.full(len(announce), -1))])
    rows_id = np.concatenate([ids[one], ids[many], np.zeros(len(announce), np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(rows_h, pa.int64()), pa.array(rows_x, pa.int64()), pa.array(rows_id, pa.int64())], ["h", "x", "_id"])


def found_elsewhere(rows: DataFrame, partitions: int) -> DataFrame:
    """The places (``_id``, ``pos``) whose value occurs at another place too."""

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, np.int64)] * 3

        def answer(h, x, ids):
            settled = x < 0
            low = x & 0xFFFFFFFF
            yield ids[settled], low[settled]
            h, c, ids, low = h[~settled], x[~settled] >> 32, ids[~settled], low[~settled]
            same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(h) else np.zeros(0, bool)
            twice &= low != 0xFFFFFFFF
            yield ids[twice], low[twice]

        def out(parts):
            ids, low = (np.concatenate(z) for z in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(low.astype(np.int64), pa.int64())], ["_id", "pos"])

        for batch in batches:
            cols = [np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(carry)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            carry = [a[cut:] for a in cols]
            if cut:
                yield out(answer(*[a[:cut] for a in cols]))
        if len(carry[0]):
            yield out(answer(*carry))

    laid = rows.repartition(partitions, "h").sortWithinPartitions("h", "x")
    return laid.mapInArrow(settle, "_id long, pos long")


def gathered(places: DataFrame) -> DataFrame:
    """Places of each text as one array, no longer than the text."""
    return places.groupBy("_id").agg(F.collect_list(F.col("pos").cast("int")).alias("_places"))


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null lists are empty."""
    filled = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(filled)]).astype(np.int64)
