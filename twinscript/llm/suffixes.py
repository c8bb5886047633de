"""Exact substring deduplication over bytes by suffix arrays.

1. Every window of ``window`` bytes has a minimizer, the gram of ``GRAM`` bytes with the least hash in
   it. Equal windows have equal minimizers, so the windows around one minimizer (a node: a run of
   starts and the bytes they reach) can only equal windows around its twins. Minimizers that occur
   once are done with; nodes that occur twice as a whole repeat as a whole.
2. What is left are nodes whose minimizer has other surroundings elsewhere, mostly the ends of
   repeated passages. Their bytes go to shards by minimizer. A shard builds a suffix array by
   Larsson-Sadakane refinement: sorted by 8 bytes first, then only unsorted groups again by twice
   the depth until ``window``. Kasai's rule gives common prefixes, and windows whose neighbour in
   the array shares ``window`` bytes repeat.
3. A minimizer with more nodes than a shard takes is spread over several. Their sorted windows are
   merged by binary search: runs of each shard go to ranges of hashes, where each window is searched.

Texts are read from a bucketed table and are never shuffled whole again.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.llm import repeats
from twinscript.llm.packing import blocks
from twinscript.llm.repeats import Powers, Rolling, mix, text_store
from twinscript.llm.substrings import _with_results
from twinscript.llm.tables import staged

WINDOW, GRAM = 400, 64
BLOCK_CHARS = 2_000_000
SHARD_NODES = 8_000  # of some 570 bytes each
SPLIT_NODES = 4_000  # of one minimizer in a shard
WHOLE, ASK, TELL = 0, 1, 2
ANSWERED = -1  # in the place of a window that needs no answer
RANGES = pa.list_(pa.struct([("first", pa.int64()), ("starts", pa.int64())]))


def _joined(texts: list[str]) -> tuple[bytes, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def minimizer_runs(data: bytes, begin: np.ndarray, window: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Runs of window starts with the same minimizer: (text, first start, starts, minimizer, its hash, node's hash)."""
    buffer = np.frombuffer(data, np.uint8)
    span = window - GRAM + 1  # grams in a window
    n = len(buffer)
    sizes = np.diff(begin)
    if not (sizes >= window).any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(buffer.astype(np.uint64) + np.uint64(1), powers)
    at = np.arange(n - GRAM + 1)
    grams = rolling.of(at, at + GRAM)
    # The upper half of the hash decides, then the place: one minimum gives value and leftmost place.
    packed = (grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    padded = np.full(-(-len(packed) // span) * span + span, 2**64 - 1, np.uint64)
    padded[: len(packed)] = packed
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    text = np.flatnonzero(sizes >= window)
    counts = sizes[text] - window + 1
    owner = np.repeat(text, counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[owner]
    least = np.minimum(behind[start], ahead[start + span - 1])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    length = np.diff(np.append(new, len(place)))
    first, place, owner = start[new], place[new], owner[new]
    node = rolling.of(first, first + length - 1 + window)
    node = mix(node ^ mix((place - first).astype(np.uint64) * np.uint64(1024) + length.astype(np.uint64)))
    return owner, first, length, place, grams[place], node


def _node_rows(texts: list[str], ids: np.ndarray, copied: np.ndarray, window: int, powers: Powers) -> pa.RecordBatch:
    """Rows to be met at the minimizer's hash; nodes alike inside this block are settled here."""
    data, begin = _joined(texts)
    owner, first, length, _, h, node = minimizer_runs(data, begin, window, powers)
    order = np.lexsort((node, h))
    owner, first, length, h, node = owner[order], first[order], length[order], h[order], node[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    tell = copied[owner]
    twice = np.bincount(group, 1 + tell)[group] > 1 if len(h) else new
    x = (first - begin[owner]) << 9 | length
    one, settled, announce = np.flatnonzero(~twice), np.flatnonzero(twice & ~tell), np.flatnonzero(new & twice)
    take = np.concatenate([one, settled, announce])
    kind = np.repeat([0, 2, 1], [len(one), len(settled), len(announce)])
    key = h[take].copy()
    apart = kind == 2
    key[apart] = mix(ids[owner[take[apart]]].view(np.uint64) ^ x[take[apart]].astype(np.uint64))
    columns = [key.view(np.int64), node[take].view(np.int64), ids[owner[take]], x[take] << 2 | kind]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "node", "_id", "x"])


def _decide(h: np.ndarray, node: np.ndarray, ids: np.ndarray, x: np.ndarray, split_nodes: int) -> pa.RecordBatch:
    """What becomes of each node, from all rows of some minimizers, sorted by minimizer and node."""
    settled = x & 3 == 2
    out = [(h[settled], ids[settled], x[settled] >> 2, np.full(settled.sum(), WHOLE), np.ones(settled.sum(), np.int64))]
    h, node, ids, x = h[~settled], node[~settled], ids[~settled], x[~settled]
    if len(h):
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_n = new_h | np.concatenate([[True], node[1:] != node[:-1]])
        of_h, of_n = np.cumsum(new_h) - 1, np.cumsum(new_n) - 1
        nodes = np.bincount(of_h[new_n])[of_h]  # different nodes of the minimizer
        announced = x & 3 == 1
        many = (np.bincount(of_n) > 1)[of_n] | (np.bincount(of_n, announced) > 0)[of_n]
        parts = -(-nodes // split_nodes)
        for action, rows in ((WHOLE, many & ~announced), (ASK, ~many & (nodes > 1)), (TELL, many & (nodes > 1) & new_n)):
            out.append((h[rows], ids[rows], x[rows] >> 2, np.full(rows.sum(), action), parts[rows]))
    columns = [np.concatenate(c) for c in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "_id", "x", "action", "parts"])


def decided(rows: DataFrame, partitions: int, split_nodes: int = SPLIT_NODES) -> DataFrame:
    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the last minimizer wait as the batches they came in and are joined once, however many they are.
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut or (held and held[0][0][0] != cols[0][0]):
                held.append([a[:cut] for a in cols])
                yield _decide(*[np.concatenate(c) for c in zip(*held)], split_nodes)
                held = []
            held.append([a[cut:] for a in cols])
        if held:
            yield _decide(*[np.concatenate(c) for c in zip(*held)], split_nodes)

    laid = rows.repartition(partitions, "h").sortWithinPartitions("h", "node")
    return laid.mapInArrow(meet, "h long, _id long, x long, action long, parts long")


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their first ``depth`` bytes, and the rank of each: the first slot of its group.

    ``text`` is followed by enough bytes for every position. Larsson-Sadakane: a group that is
    down to one member is never touched again.
    """
    n = len(text) - depth
    eight = np.zeros(n, np.uint64)
    for i in range(8):
        eight |= text[i : n + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    order = np.argsort(eight, kind="stable")
    new = np.concatenate([[True], eight[order[1:]] != eight[order[:-1]]])
    slots = np.arange(n)
    rank = np.full(n + depth, -1, np.int64)  # what lies behind the end sorts first
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    known = 8
    while known < depth:
        step = min(known, depth - known)
        head = rank[order]
        alone = np.concatenate([new[1:], [True]]) & new
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        members, group = order[open_], head[open_]
        following = rank[members + step]
        again = np.lexsort((following, group))
        members, group, following = members[again], group[again], following[again]
        split = np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])])
        order[open_] = members
        new[open_] = split
        rank[members] = np.maximum.accumulate(np.where(split, open_, 0))
        known += step
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each position of ``order`` but the first shares with the one before it.

    Exact up to half of ``limit``, and no less than that half where more are shared. Kasai's rule in the
    order of the text: where a position and its neighbour both follow a compared pair, they share one byte
    less; only the other pairs are compared, all at once and up to ``limit``, and one of every limit / 2.
    """
    shared = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return shared
    at, before, slot = order[1:], order[:-1], np.arange(1, len(order))
    by_place = np.argsort(at)
    at, before, slot = at[by_place], before[by_place], slot[by_place]
    follows = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (before[1:] == before[:-1] + 1)])
    heads = np.flatnonzero(~follows)
    follows &= (np.arange(len(at)) - heads[np.cumsum(~follows) - 1]) % (limit // 2) != 0
    heads = np.flatnonzero(~follows)
    length, alive = np.zeros(len(heads), np.int64), np.arange(len(heads))
    a, b = at[heads], before[heads]
    for i in range(limit):
        alive = alive[(np.maximum(a[alive], b[alive]) + i < len(text))]
        alive = alive[text[a[alive] + i] == text[b[alive] + i]]
        length[alive] += 1
        if not len(alive):
            break
    head = np.cumsum(~follows) - 1
    shared[slot] = length[head] - (np.arange(len(at)) - heads[head])
    return shared


def _shard(table: pa.Table, window: int) -> pa.Table:
    """Repeated windows of a shard's nodes (kind 0: _id, first start, starts), and sorted runs of the windows
    of spread minimizers that another shard may hold too (kind 1)."""
    table = table.sort_by([("_id", "ascending"), ("first", "ascending")])
    ids, first, count, tell, parts = (table[c].to_numpy() for c in ("_id", "first", "starts", "tell", "parts"))
    nodes = table["bytes"].to_pylist()
    begin = np.concatenate([[0], np.cumsum([len(b) for b in nodes])]).astype(np.int64)
    text = np.frombuffer(b"".join(nodes) + bytes(window), np.uint8)
    order, rank = suffix_array(text, window)
    node = np.repeat(np.arange(len(nodes)), count)
    offset = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
    place = begin[node] + offset
    # Only starts of the nodes' own windows; every start of a text belongs to one node.
    owner = np.full(len(rank), -1)
    owner[place] = np.arange(len(place))
    mine = order[owner[order] >= 0]
    like_before = common_prefixes(text, mine, 2 * window) >= window
    like_next = np.append(like_before[1:], False)
    item = owner[mine]
    told = tell[node[item]] > 0
    group = np.cumsum(~like_before) - 1
    repeated = (like_before | like_next) | told
    hit = np.zeros(len(place), bool)
    hit[item[repeated & ~told]] = True
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A run may reach over a node's end into the next node of the array; cut it there.
    cuts = np.unique(np.concatenate([lo, np.flatnonzero(hit & (offset == 0))]))
    ends = hi[np.searchsorted(hi, cuts, side="right")] if len(cuts) else cuts
    ends = np.minimum(ends, np.append(cuts[1:], len(hit)))
    found = [[0, 0, i, f, n, b""] for i, f, n in zip(ids[node[cuts]].tolist(), (first[node[cuts]] + offset[cuts]).tolist(), (ends - cuts).tolist())]
    lead = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    wide = np.flatnonzero((parts[node[item]] > 1) & lead)
    if len(wide):
        found += _runs_to_merge(text, mine[wide], window, table["h"].to_numpy()[node[item[wide]]], parts[node[item[wide]]], ids[node[item[wide]]], np.where(repeated[wide], ANSWERED, first[node[item[wide]]] + offset[item[wide]]))
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * 6, [pa.int64()] * 5 + [pa.binary()])], ["kind", "key", "_id", "first", "starts", "run"])


def _runs_to_merge(text, spots, window, minimizer, parts, ids, first) -> list[list]:
    """The distinct windows of spread minimizers, one sorted run per minimizer and range of window hashes."""
    powers = Powers()
    values = text.astype(np.uint64) + np.uint64(1)
    h = Rolling(values, powers).of(spots, spots + window)
    check = (Rolling(mix(values), powers).of(spots, spots + window) >> np.uint64(33)).astype(np.int64)
    key = mix(minimizer.view(np.uint64) ^ mix((h >> np.uint64(32)) % (2 * parts).astype(np.uint64))).view(np.int64)
    order = np.lexsort((check, h, key))
    rows = np.stack([h.view(np.int64), check, ids, first], 1)[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
    return [[1, int(key[order[a]]), 0, 0, 0, rows[a:b].tobytes()] for a, b in zip(edges[:-1], edges[1:])]


def _merged(table: pa.Table) -> pa.Table:
    """Places of windows that several shards hold: each window of each run is searched in all runs."""
    runs = [np.frombuffer(r, np.int64).reshape(-1, 4) for r in table["run"].to_pylist()]
    rows = np.concatenate(runs)
    _, value = np.unique(rows[:, 0], return_inverse=True)
    value = value << 31 | rows[:, 1]
    merged = np.sort(value)
    held = np.searchsorted(merged, value, "right") - np.searchsorted(merged, value, "left")
    rows = rows[(held > 1) & (rows[:, 3] != ANSWERED)]
    rows = rows[np.argsort(rows[:, 2], kind="stable")]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(rows[:, 2])) + 1, [len(rows)]]) if len(rows) else np.zeros(1, int)
    places = [[{"first": f, "starts": 1} for f in rows[a:b, 3].tolist()] for a, b in zip(edges[:-1], edges[1:])]
    return pa.table([pa.array(rows[edges[:-1], 2], pa.int64()), pa.array(places, RANGES)], ["_id", "_ranges"])


def deduplicated_bytes(docs: DataFrame, window: int = WINDOW, shard_nodes: int = SHARD_NODES, split_nodes: int = SPLIT_NODES) -> DataFrame:
    """Per distinct text: ``_id``, ``_key``, n_bytes, n_removed, n_spans, the kept bytes (null if none goes) and their kept_sha256."""
    if not GRAM < window < GRAM + 447:
        raise ValueError("a window must be longer than a gram, and its grams fewer than 448")
    spark = docs.sparkSession
    store = text_store(docs)
    size = store.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (4 * repeats.STORE_BYTES)))

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, copied, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy() > 1, batch.column(2).to_pylist()
            for lo, hi in blocks(texts, BLOCK_CHARS):
                yield _node_rows(texts[lo:hi], ids[lo:hi], copied[lo:hi], window, powers)

    met = store.select("_id", "copies", "text").mapInArrow(nodes, "h long, node long, _id long, x long")
    fates = staged(decided(met, width, split_nodes), "suffix-nodes")
    whole = fates.filter(F.col("action") == WHOLE).select("_id", F.shiftright("x", 9).alias("first"), F.col("x").bitwiseAND(F.lit(511)).alias("starts"))
    asked = fates.filter(F.col("action") != WHOLE)
    shards = max(width, -(-asked.count() // shard_nodes))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for i, t, ws in zip(ids, texts, wanted):
                raw = t.encode("utf-8", "surrogatepass")
                for w in ws:
                    at, n = w["x"] >> 9, w["x"] & 511
                    part = (i ^ at * 0x9E3779B1) % w["parts"]
                    rows.append((w["h"], part, i, at, n, int(w["action"] == TELL), w["parts"], raw[at : at + n - 1 + window]))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "part", "_id", "first", "starts", "tell", "parts", "bytes"])

    wanted = asked.groupBy("_id").agg(F.collect_list(F.struct("h", "x", "action", "parts")).alias("_wanted"))
    strings = store.join(wanted, "_id").select("_id", "text", "_wanted").mapInArrow(cut, "h long, part long, _id long, first long, starts long, tell long, parts long, bytes binary")
    strings = strings.withColumn("_shard", F.pmod(F.xxhash64("h", "part"), F.lit(shards)))

    def shard(table: pa.Table) -> pa.Table:
        return _shard(table, window)

    found = staged(strings.groupBy("_shard").applyInArrow(shard, "kind long, key long, _id long, first long, starts long, run binary"), "suffix-windows")
    single = F.array(F.struct("first", "starts")).alias("_ranges")
    inside = found.filter("kind = 0").select("_id", single)
    between = found.filter("kind = 1").select("key", "run").groupBy("key").applyInArrow(_merged, "_id long, _ranges array<struct<first: long, starts: long>>")
    ranges = whole.select("_id", single).unionByName(inside).unionByName(between)
    by_text = ranges.groupBy("_id").agg(F.flatten(F.collect_list("_ranges")).alias("_ranges"))

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copied = batch.column(2).to_pylist()
            rows = []
            for j, (text, found) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                raw = text.encode("utf-8", "surrogatepass")
                marks = np.zeros(len(raw) + 1, np.int32)
                if copied[j] > 1 and len(raw) >= window:
                    marks[0], marks[-1] = 1, -1
                elif copied[j] == 1 and found:
                    at = np.array([(f["first"], f["first"] + f["starts"] - 1 + window) for f in found])
                    np.add.at(marks, at[:, 0], 1)
                    np.add.at(marks, at[:, 1], -1)
                gone = np.cumsum(marks)[:-1] > 0
                n = int(gone.sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if n else raw
                spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                rows.append((len(raw), n, spans, kept if n else None, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["_id", "_key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    judged = store.join(by_text, "_id", "left").select("_id", "_key", "copies", "text", "_ranges")
    return judged.mapInArrow(remove, "_id long, _key binary, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def suffix_array_dedup(docs: DataFrame, window: int = WINDOW, shard_nodes: int = SHARD_NODES, split_nodes: int = SPLIT_NODES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A null text counts as empty. A text that stands in several rows repeats as a whole, so each of
    its rows loses all its bytes if it has a window. Null doc_ids and repeated rows stay rows; an
    empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    results = deduplicated_bytes(docs, window, shard_nodes, split_nodes)
    return _with_results(docs.select("doc_id", "text"), results, "n_bytes", "n_removed", "n_spans", "kept_sha256").drop("text")
