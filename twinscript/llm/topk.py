"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A dimension is a term, a block of candidates keeps one posting list per term. A query
row walks its non-zero terms, adds weight times posting to a dense array of scores, and
the best of the array are selected. Queries and candidates meet block by block: both are
dealt to cells of bounded size, so neither side is ever broadcast or held whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES_PER_CELL = 4096
QUERIES_PER_CELL = 1024
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def _matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Integers of each row, shorter rows filled with zero."""
    lists = column.combine_chunks()
    if not len(lists):
        return np.zeros((0, 0))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _scores(weights: np.ndarray, postings: list[tuple[np.ndarray | slice, np.ndarray]], n: int, exact: type) -> np.ndarray:
    score = np.zeros(n, exact)
    for term in np.flatnonzero(weights):
        if term < len(postings):
            rows, values = postings[term]
            score[rows] += exact_int(weights[term], exact) * values
    return score


def exact_int(x: float, kind: type):
    return int(x) if kind is object else np.int64(x)


def _postings(matrix: np.ndarray, exact: type) -> list:
    lists = []
    for column in matrix.T:
        rows = np.flatnonzero(column)
        values = np.array([int(v) for v in column[rows]], object) if exact is object else column[rows].astype(np.int64)
        lists.append((slice(None) if len(rows) == len(column) else rows, values))
    return lists


def best_of_cell(queries: pa.Table, candidates: pa.Table, k: int, scale: float) -> pa.Table:
    """The k best candidates of this cell for each of its queries."""
    q, c = _matrix(queries["_v"], scale), _matrix(candidates["_v"], scale)
    q_ids, q_keys = queries["_id"].to_numpy(), queries["_q"].to_numpy()
    c_ids = candidates["_id"].to_numpy()
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, min(q.shape[1], c.shape[1]))
    exact = np.int64 if bound < 2**62 else object
    postings = _postings(c, exact)
    out = []
    for key, own, weights in zip(q_keys, q_ids, q):
        score = _scores(weights, postings, len(c_ids), exact)
        rows = np.flatnonzero(c_ids != own)
        score = score[rows]
        if exact is object:
            score = np.array([min(max(s, LONG_MIN), LONG_MAX) for s in score], np.int64)
        if len(rows) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            near = np.flatnonzero(score >= least)
            rows, score = rows[near], score[near]
        best = np.lexsort((c_ids[rows], ~score))[:k]
        out.append((np.full(len(best), key), np.full(len(best), own), c_ids[rows][best], score[best]))
    columns = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else [()] * 4)]
    return pa.table([pa.array(x, pa.int64()) for x in columns], ["_q", "query_id", "vec_id", "score"])


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: float = 1024.0,
    candidates_per_cell: int = CANDIDATES_PER_CELL,
    queries_per_cell: int = QUERIES_PER_CELL,
) -> DataFrame:
    """The k highest integer inner products of each query row with every row of another vec_id.

    Rows with a null vec_id, and vectors that are null or hold null or non-finite components,
    take no part. A shorter vector counts as filled with zeros. A vec_id that stands in several
    rows is a candidate once per row and never its own; identical query rows are one query.
    Equal scores go to the smaller vec_id. A score beyond 64 bits is held at the limit.
    An empty table gives an empty result.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("_id"), v.alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_is_query"))
    rows = rows.filter(F.coalesce(sound, F.lit(False)))
    asked = rows.filter("_is_query").select("_id", "_v", F.xxhash64("_id", "_v").alias("_q")).dropDuplicates(["_q"])
    n, n_asked = rows.count(), asked.count()
    cells, layers = max(1, -(-n // candidates_per_cell)), max(1, -(-n_asked // queries_per_cell))
    # The id takes part, so rows that share one very common vector spread over the cells.
    spread = F.pmod(F.xxhash64("_id", "_v"), F.lit(cells)).cast("int")
    left = asked.withColumns(
        {"_layer": F.pmod(F.xxhash64("_q"), F.lit(layers)).cast("int"), "_cell": F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))}
    )
    right = rows.select("_id", "_v", spread.alias("_cell"), F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("_layer"))
    met = left.groupBy("_layer", "_cell").cogroup(right.groupBy("_layer", "_cell"))

    def score(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return best_of_cell(queries, candidates, k, scale)

    best = met.applyInArrow(score, "_q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("_q", "query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
