"""Near-duplicate documents by SimHash fingerprints and pivot distance tables.

1. A fingerprint is the majority bit of the hashes of a text's word shingles.
2. Each distinct fingerprint is routed by blocks of its bits: of five blocks, fingerprints
   that differ in three bits agree in two at least, so every linked pair shares one of the
   ten tables' keys. No pair is lost and no row is compared with all others.
3. Inside a key, the table of Hamming distances to fixed reference fingerprints discards
   pairs: distances to a pivot differ by no more than the pair does (triangle inequality).
   Survivors are verified bit by bit. Of the links in a key only a spanning forest leaves
   the task, so a group of copies costs one row a member, not one a pair.
4. Links become components by rounds of minimum labels over joins, staged in between.
"""

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.llm.packing import blocks
from twinscript.llm.repeats import Powers, Rolling, mix, offsets_of
from twinscript.llm.substrings import words_of
from twinscript.llm.tables import content_key, drop_stage, staged, text_of
from twinscript.operators.joins import join_hot

BITS, WIDEST, SEED = 64, 3, 42
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
TABLES = list(combinations(range(len(BLOCKS)), len(BLOCKS) - WIDEST))
PIVOTS = 24
PAIRS_AT_ONCE = 2_000_000
KEY_NODES = 4_096  # of one key in a group


def pivots(lanes: int, n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints of 64 bits a lane: hashes of their own numbers."""
    made = [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) for i in range(n * lanes)]
    return np.array(made, np.uint64).reshape(n, lanes)


def _shingle_hashes(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and their number per text (none for a text without a word)."""
    hashes, sizes = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            sizes.append(0)
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(words) - shingle + 1)
        last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
        hashes.extend(xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist()))
        sizes.append(n)
    return np.array(hashes, np.uint64), np.array(sizes, np.int64)


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits set in over half of each text's hashes; zero without one."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    votes = np.zeros((len(full), BITS), np.int64)
    owner = np.repeat(np.arange(len(full)), sizes[full])
    # In pieces, so that the unpacked bits of long texts stay small.
    for at in range(0, len(hashes), 1 << 18):
        part, whose = hashes[at : at + (1 << 18)], owner[at : at + (1 << 18)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = [0, *(np.flatnonzero(np.diff(whose)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            votes[whose[a]] += bits[a:b].sum(0, dtype=np.int64)
    majority = (2 * votes > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``_fp`` (as a signed long) of every document besides the columns of ``keep``."""
    def hash_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for lo, hi in blocks(texts, 2_000_000):
                fp = pa.array(_majority(*_shingle_hashes(texts[lo:hi], shingle)).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(len(keep))], fp], [*keep, "_fp"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, text_of().alias("_t")).mapInArrow(hash_batches, f"{kinds}, _fp long")


def _table_key(table: int) -> Column:
    """The bits of the table's blocks, below the number of the table."""
    key = F.lit(table).cast("long")
    for block in TABLES[table]:
        at, width = BLOCKS[block]
        bits = F.shiftrightunsigned("_fp", at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        key = F.shiftleft(key, width).bitwiseOR(bits)
    return key


def _linked(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, widest: int | np.ndarray) -> np.ndarray:
    """Those of the pairs (i, j) that are links: pivot distances first, one pivot after another, then all bits."""
    alive = np.arange(len(i))
    widest = np.broadcast_to(widest, len(i))
    for pivot in range(table.shape[1]):
        alive = alive[np.abs(table[i[alive], pivot] - table[j[alive], pivot]) <= widest[alive]]
        if len(alive) < 1024:
            break
    return alive[np.bitwise_count(fps[i[alive]] ^ fps[j[alive]]).sum(1, dtype=np.int64) <= widest[alive]]


class Forest:
    """Union-find over the members of one key."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links_of_groups(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, widest: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside each run of equal keys."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    links, forests = [], {}
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    remaining = starts[1:][group] - np.arange(len(keys)) - 1  # members after each one
    step = 1
    while (active := np.flatnonzero(remaining >= step)).size:
        for at in range(0, len(active), PAIRS_AT_ONCE):
            i = active[at : at + PAIRS_AT_ONCE]
            for x in i[_linked(fps, table, i, i + step, widest)].tolist():
                if forests.setdefault(group[x], Forest()).joins(x, x + step):
                    links.append((x, x + step))
        step += 1
    return links


def _runs_of_keys(routed: DataFrame, lanes: list[str], more: list[str], pairs_of, key_nodes: int = KEY_NODES) -> DataFrame:
    """Distinct pairs (a, b) of nodes that ``pairs_of(keys, fps, table, *more)`` finds in groups of ``_key``.

    A key of more than ``key_nodes`` nodes is met in blocks, two at a time.
    """
    references = pivots(len(lanes))
    own = len(more)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.zeros(0, np.int64) for _ in range(2 + own)] + [np.zeros((0, len(lanes)), np.uint64)]

        def found(columns):
            # A key of its own has no partner; drop those before the table is made.
            same = columns[0][1:] == columns[0][:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            keys, nodes, *others, fps = [c[shared] for c in columns]
            if not len(keys):
                return None
            table = np.stack([np.bitwise_count(fps ^ r).sum(1, dtype=np.int16) for r in references], 1)
            pairs = np.array(pairs_of(keys, fps, table, *others), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], ["a", "b"])

        for batch in batches:
            fresh = [batch.column(i).to_numpy() for i in range(2 + own + len(lanes))]
            fresh = [*fresh[: 2 + own], np.stack(fresh[2 + own :], 1).view(np.uint64)]
            columns = [np.concatenate(c) for c in zip(carry, fresh)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            carry = [c[cut:] for c in columns]
            if cut and (out := found([c[:cut] for c in columns])) is not None:
                yield out
        if len(carry[0]) and (out := found(carry)) is not None:
            yield out

    width = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = _parted(routed.select("_key", "_node", *more, *lanes).distinct(), key_nodes)
    laid = parted.repartition(width, "_key").sortWithinPartitions("_key", "_node")
    return laid.mapInArrow(search, "a long, b long").distinct()


def _parted(routed: DataFrame, most: int) -> DataFrame:
    """``routed`` with the keys of more than ``most`` nodes replaced by keys for any two blocks of their nodes.

    Any two nodes of a key still share one, and no key has more than about ``2 * most``.
    """
    nodes = routed.groupBy("_key").agg(F.count("*").alias("_members")).filter(F.col("_members") > most)
    blocks_of = nodes.select("_key", F.greatest(F.lit(2), F.ceil(F.col("_members") / most)).cast("int").alias("_blocks"))
    placed = join_hot(routed, blocks_of, "_key", "left")
    own = F.pmod(F.xxhash64("_node"), F.coalesce("_blocks", F.lit(1))).cast("int")
    others = F.array_except(F.sequence(F.lit(0), F.coalesce(F.col("_blocks") - 1, F.lit(1))), F.array("_own"))
    met = placed.withColumn("_own", own).withColumn("_other", F.explode(F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(others)))
    pair = F.xxhash64("_key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return met.withColumn("_key", F.when(F.col("_blocks").isNull(), F.col("_key")).otherwise(pair)).drop("_blocks", "_own", "_other")


def links(routed: DataFrame, lanes: list[str], widest: int) -> DataFrame:
    """Links (a, b) between nodes that span every group of ``_key``; ``lanes`` hold a node's fingerprint."""
    return _runs_of_keys(routed, lanes, [], lambda keys, fps, table: _links_of_groups(keys, fps, table, widest))


def by_blocks(prints: DataFrame) -> DataFrame:
    """Every distinct fingerprint under the key of each table, for links of three bits at most."""
    keys = F.array(*[_table_key(t) for t in range(len(TABLES))])
    return prints.select("_fp").distinct().select(F.explode(keys).alias("_key"), F.col("_fp").alias("_node"), "_fp")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node ``a`` has one ``b`` and no ``b`` is an ``a`` itself: then no round changes anything."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("_up"), F.lit(0).alias("_top"))
    ends = ends.unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("_up"), F.lit(1).alias("_top")))
    return ends.groupBy("x").agg(F.sum("_up").alias("_ups"), F.max("_top").alias("_top")).filter("_ups > 0 AND _ups + _top > 1").isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and its ``root``, the smallest node reachable, for every node with a link.

    Rounds of large-star and small-star over joins until only stars are left; a node only ever
    points to smaller ones, so a chain shortens by more than half in a pair of rounds.
    """
    spans = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while not _is_stars(edges):
        # Large star: every larger neighbour points to the smallest one around.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_hot(both, least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large.filter("a <> b"), label)
        drop_stage(edges)
        # Small star: a node and its smaller neighbours point to the smallest of these.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = join_hot(large, lowest, "a").select(F.explode(F.array("a", "b")).alias("x"), "m")
        edges = staged(moved.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), label)
        drop_stage(large)
    rooted = staged(spans(edges), label)
    drop_stage(edges)
    return rooted


def near_duplicates(docs: DataFrame, shingle: int = 3, widest: int = WIDEST) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    A null text counts as empty; texts without a word have the fingerprint zero and link like
    others. Repeated rows stay rows. A null doc_id takes part in links but is no component's
    smallest; a component of null doc_ids alone has a null component_id. An empty table gives
    an empty result. Columns besides doc_id and text are not read.
    """
    if widest > WIDEST:
        raise ValueError(f"the tables find links of {WIDEST} bits at most")
    prints = staged(fingerprints(docs, shingle), "fingerprints")
    roots = components(links(by_blocks(prints), ["_fp"], widest), "near-duplicates")
    by_print = prints.groupBy("_fp").agg(F.min("doc_id").alias("_least"))
    rooted = by_print.join(roots, by_print["_fp"] == roots["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    rooted = staged(rooted, "near-duplicates")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    classes = join_hot(rooted.select("_fp", "_root"), least, "_root").select("_fp", "component_id")
    digits = F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint")
    return join_hot(prints, classes, "_fp").select("doc_id", digits, "component_id")


# Four lanes of 64 bits tell similarities apart that one lane cannot: texts whose sets of shingles are alike
# by 0.8 differ in 39 of 256 bits on average with a deviation of 6. Pairs up to WIDE_LINK bits are candidates.
# A set of few shingles strays further, so those of less than FEW are candidates whatever their bits.
LANES, WIDE_LINK, FEW = 4, 76, 32
NEAREST_FIRST = (32, 46, 58)
BLOCK_HASHES = 1_000_000  # shingles of the sets decided in one group
PIVOT_SETS = 16  # of a large cluster, in each of its groups
BANDS, ROWS = 32, 4  # of least hashes; texts alike by 0.8 share no band with a chance of 5 in 100 million
ALIKE = (4, 5)  # a similarity of 4/5


def _bands(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A key per band: the least values of the text's hashes under ROWS orders. All zero without a word."""
    out = np.zeros((len(sizes), BANDS), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    cuts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    for order in range(0, BANDS * ROWS, 2):
        mixed = mix(hashes + np.uint64((order + 1) * 0xD6E8FEB86659FD93 % 2**64))
        for half in (mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF)):
            band = order // ROWS
            out[full, band] = mix(out[full, band] * np.uint64(3) + np.minimum.reduceat(half, cuts) + np.uint64(band))
    return out


def _rolling_hashes(texts: list[str], shingle: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """What ``_shingle_hashes`` returns, by another hash that needs one pass over all bytes and one over all words."""
    words = words_of(texts, powers, lower=True)
    count = np.diff(words.first)
    sizes = np.where(count > 0, np.maximum(1, count - shingle + 1), 0)
    owner = np.repeat(np.arange(len(count)), sizes)
    start = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + words.first[owner]
    stop = np.minimum(start + shingle, words.first[owner + 1])
    return Rolling(words.hashes, powers).of(start, stop), sizes


def _distinct(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes once, in ascending order, and their number."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    hashes = np.concatenate([np.sort(part) for part in np.split(hashes, np.cumsum(sizes)[:-1])])
    once = np.ones(len(hashes), bool)
    once[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[once], np.bincount(owner[once], minlength=len(sizes)).astype(np.int64)


def _wide_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """``_id`` of a row, doc_id, its set of shingles as ``_node`` and their number, the lanes of its fingerprint, its band keys."""
    lanes = [f"_f{i}" for i in range(LANES)]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hash_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in blocks(texts):
                hashes, sizes = _distinct(*_rolling_hashes(texts[lo:hi], shingle, powers))
                wide = [_majority(hashes if i == 0 else mix(hashes ^ np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)), sizes) for i in range(LANES)]
                keys = _bands(hashes, sizes).view(np.int64)
                sets = np.split(hashes, np.cumsum(sizes)[:-1])
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(nodes), pa.array(sizes)]
                columns += [*[pa.array(w.view(np.int64)) for w in wide], pa.array(list(keys), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "doc_id", "_node", "_n", *lanes, "_keys"])

    schema = f"_id string, doc_id {kind}, _node long, _n long, {', '.join(f'{x} long' for x in lanes)}, _keys array<long>"
    return docs.select(_row_id().alias("_id"), "doc_id", text_of().alias("_t")).mapInArrow(hash_batches, schema)


def _shingle_sets(docs: DataFrame, firsts: DataFrame, shingle: int) -> DataFrame:
    """``_cluster``, ``_node`` and its distinct shingle hashes, from the rows of ``docs`` that ``firsts`` (``_id, _node, _cluster``) names."""

    def hash_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in blocks(texts):
                hashes, sizes = _distinct(*_rolling_hashes(texts[lo:hi], shingle, powers))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                sets = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), sets], ["_cluster", "_node", "_set"])

    # Rows alike in doc_id and text share an id; one of them is enough.
    rows = docs.select(_row_id().alias("_id"), text_of().alias("_t")).join(firsts, "_id").dropDuplicates(["_id"])
    return rows.select("_cluster", "_node", "_t").mapInArrow(hash_batches, "_cluster long, _node long, _set array<long>")


def _room(sizes: np.ndarray, i: np.ndarray, j: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the sizes of two sets allow a similarity of ALIKE, and the bits that may differ."""
    less, more = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    return ALIKE[1] * less >= ALIKE[0] * more, np.where(less < FEW, LANES * BITS, widest)


def _nearest_proposals(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, sizes: np.ndarray, widest: int) -> list[tuple[int, int]]:
    """Like a spanning forest of the proposed pairs inside each run of equal keys, nearest fingerprints first."""
    remaining = _remaining(keys)
    forest, tops, out = Forest(), np.arange(len(keys)), []
    for limit in (*NEAREST_FIRST, widest):
        step = 1
        while (active := np.flatnonzero(remaining >= step)).size:
            for at in range(0, len(active), PAIRS_AT_ONCE):
                i = active[at : at + PAIRS_AT_ONCE]
                i = i[tops[i] != tops[i + step]]
                fits, room = _room(sizes, i, i + step, widest)
                i, room = i[fits], room[fits] if limit == widest else limit
                for x in i[_linked(fps, table, i, i + step, room)].tolist():
                    if forest.joins(x, x + step):
                        out.append((x, x + step))
            step += 1
        tops = np.fromiter((forest.top(x) for x in range(len(keys))), np.int64, len(keys))
    return out


def _remaining(keys: np.ndarray) -> np.ndarray:
    """Members of the same run of equal keys after each one."""
    ends = np.concatenate([np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    return np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(keys)) - 1


def linked_sets(sizes: np.ndarray, values: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets alike by ALIKE that connect whatever such pairs connect, beyond what ``part`` connects already.

    ``values`` are the members of all sets, one after another. A set is counted against all later ones outside its
    part at once.
    """
    codes = np.unique(values, return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    marked, part, out = np.zeros(len(values), bool), part.copy(), []
    for i in range(len(sizes) - 1):
        less, more = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        rest = i + 1 + np.flatnonzero((part[i + 1 :] != part[i]) & (ALIKE[1] * less >= ALIKE[0] * more) & (less > 0))
        if not len(rest):
            continue
        own = codes[at[i] : at[i + 1]]
        marked[own] = True
        if 4 * len(rest) > len(sizes) - i:
            hits = marked[codes[at[i + 1] :]]
            shared = np.concatenate([[0], np.cumsum(hits)])
            shared = shared[at[rest + 1] - at[i + 1]] - shared[at[rest] - at[i + 1]]
        else:
            shared = np.array([np.count_nonzero(marked[codes[at[j] : at[j + 1]]]) for j in rest.tolist()])
        marked[own] = False
        # shared / (a + b - shared) >= 4 / 5 in whole numbers.
        for j in rest[sum(ALIKE) * shared >= ALIKE[0] * (sizes[i] + sizes[rest])].tolist():
            if part[j] != part[i]:
                out.append((i, j))
                part[part == part[j]] = part[i]
    return out


def _links_of_groups_of_sets(grouped: DataFrame) -> DataFrame:
    """Links (a, b) inside each group of ``_group``: rows are ``_group, _node, _part, _set``, a group fits in memory."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[pa.RecordBatch] = []

        def decided(rows: pa.Table) -> pa.RecordBatch:
            group, node, part = (rows.column(k).to_numpy() for k in range(3))
            sets = rows.column(3).combine_chunks()
            sets = pa.concat_arrays(sets.chunks) if isinstance(sets, pa.ChunkedArray) else sets
            values, at = offsets_of(sets)
            pairs = []
            edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
                # The same node may come by several ways.
                once = lo + np.unique(node[lo:hi], return_index=True)[1]
                if len(once) > 1:
                    sizes = at[once + 1] - at[once]
                    own = values[at[lo] : at[hi]] if len(once) == hi - lo else np.concatenate([values[at[x] : at[x + 1]] for x in once])
                    if len(once) == hi - lo:
                        once = np.arange(lo, hi)
                        sizes = np.diff(at[lo : hi + 1])
                    pairs += [(once[i], once[j]) for i, j in linked_sets(sizes, own, part[once])]
            pairs = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            group = batch.column(0).to_numpy()
            cut = int(np.searchsorted(group, group[-1]))
            if carry and carry[0].column(0)[0].as_py() != group[-1]:
                # All groups before the batch's last one are complete.
                yield decided(pa.Table.from_batches([*carry, batch.slice(0, cut)]))
                carry = [batch.slice(cut)]
            elif carry:
                carry.append(batch)
            else:
                if cut:
                    yield decided(pa.Table.from_batches([batch.slice(0, cut)]))
                carry = [batch.slice(cut)]
        if carry:
            yield decided(pa.Table.from_batches(carry))

    width = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = grouped.select("_group", "_node", "_part", "_set").repartition(width, "_group").sortWithinPartitions("_group", "_node")
    return laid.mapInArrow(search, "a long, b long")


def cluster_links(clustered: DataFrame, block: int = BLOCK_HASHES) -> DataFrame:
    """Links (a, b) between alike nodes of the same ``_cluster``, enough to connect all that alike pairs connect.

    ``clustered`` (``_cluster, _node, _set``) is read several times. A cluster of up to ``block`` hashes is decided in one
    group. A larger one is first decided block by block, its first nodes standing in every block as pivots, which
    connects most of it. Of what stays in several parts, all but the largest part is met with everything, block by
    block; nodes of one part are not compared again.
    """
    sizes = clustered.groupBy("_cluster").agg(F.sum(F.size("_set").cast("long")).alias("_hashes"), F.count("*").alias("_nodes"))
    several = sizes.filter("_nodes > 1").select("_cluster", F.greatest(F.lit(1), F.ceil(F.col("_hashes") / block)).cast("int").alias("_blocks"))
    sized = join_hot(clustered, several, "_cluster")
    own = F.pmod(F.xxhash64("_node"), F.col("_blocks"))
    first = sized.withColumn("_own", own).select(F.xxhash64("_cluster", "_own").alias("_group"), "_node", F.col("_node").alias("_part"), "_set")
    large = staged(several.filter("_blocks > 1"), "near-large")
    if large.isEmpty():
        drop_stage(large)
        return _links_of_groups_of_sets(first)
    in_large = join_hot(clustered, large, "_cluster")
    rank = Window.partitionBy("_cluster").orderBy("_node")
    leaders = in_large.select("_cluster", "_node", "_blocks").withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= PIVOT_SETS)
    everywhere = leaders.withColumn("_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("_cluster", "_node", "_own")
    pivots_in = join_hot(clustered, everywhere.drop("_cluster"), "_node").select(F.xxhash64("_cluster", "_own").alias("_group"), "_node", F.col("_node").alias("_part"), "_set")
    found = staged(_links_of_groups_of_sets(first.unionByName(pivots_in)), "near-links")
    parts = components(found, "near-parts").select(F.col("node").alias("_node"), F.col("root").alias("_part"))
    labelled = in_large.select("_cluster", "_node", F.size("_set").cast("long").alias("_n")).join(parts, "_node", "left")
    labelled = staged(labelled.withColumn("_part", F.coalesce("_part", "_node")), "near-labels")
    of_part = labelled.groupBy("_cluster", "_part").agg(F.sum("_n").alias("_hashes"))
    largest = of_part.groupBy("_cluster").agg(F.max(F.struct("_hashes", "_part")).alias("_main"), F.sum("_hashes").alias("_all"), F.count("*").alias("_parts"))
    open_ = largest.filter("_parts > 1").select(
        "_cluster", F.col("_main._part").alias("_main"),
        F.ceil(F.col("_main._hashes") / block).cast("int").alias("_mains"),
        F.greatest(F.lit(1), F.ceil((F.col("_all") - F.col("_main._hashes")) / block)).cast("int").alias("_strays"),
    )
    nodes = join_hot(labelled, open_, "_cluster")
    stray = F.col("_part") != F.col("_main")
    at = F.pmod(F.xxhash64("_node"), F.when(stray, F.col("_strays")).otherwise(F.col("_mains"))).cast("int")
    # Strays meet strays of every block and every block of the largest part; blocks of that part meet strays only.
    strays, mains = F.sequence(F.lit(0), F.col("_strays") - 1), F.sequence(F.lit(0), F.col("_mains") - 1)
    meets = F.when(stray, F.concat(
        F.transform(strays, lambda k: F.struct(F.least("_at", k).alias("i"), F.greatest("_at", k).alias("j"), F.lit(False).alias("m"))),
        F.transform(mains, lambda k: F.struct(F.col("_at").alias("i"), k.alias("j"), F.lit(True).alias("m"))),
    )).otherwise(F.transform(strays, lambda k: F.struct(k.alias("i"), F.col("_at").alias("j"), F.lit(True).alias("m"))))
    met = nodes.withColumn("_at", at).withColumn("_m", F.explode(meets))
    met = met.select(F.xxhash64("_cluster", "_m.i", "_m.j", "_m.m").alias("_group"), "_node", "_part")
    again = join_hot(clustered.select("_node", "_set"), met, "_node")
    more = staged(_links_of_groups_of_sets(again), "near-more-links")
    return found.unionByName(more)


def similar_pairs(docs: DataFrame, prints: DataFrame, shingle: int, widest: int, key_nodes: int = KEY_NODES, block: int = BLOCK_HASHES) -> DataFrame:
    """Pairs (a, b) of nodes alike by 0.8 or more, enough of them to connect every group of such nodes.

    Two nodes are a candidate where a band and the sizes agree and the fingerprints are near. Inside each key a
    forest, nearest first, is all that leaves the task, so keys make rows in proportion to their nodes. What
    candidates connect is a cluster; sets of shingles are sent to clusters, once each, and decided there exactly.
    """
    lanes = [f"_f{i}" for i in range(LANES)]
    keyed = prints.select(F.explode(F.array_distinct("_keys")).alias("_key"), "_node")
    # Fingerprints travel only to keys that two nodes share.
    several = keyed.groupBy("_key").agg(F.min("_node").alias("lo"), F.max("_node").alias("hi")).filter("lo <> hi").select("_key")
    keyed = join_hot(keyed, several, "_key").distinct()
    nodes = prints.select("_node", "_n", *lanes).distinct()
    routed = staged(keyed.join(nodes, "_node").select("_key", "_node", "_n", *lanes), "near-routes")
    nearest = staged(_runs_of_keys(routed, lanes, ["_n"], lambda *c: _nearest_proposals(*c, widest), key_nodes), "near-proposals")
    drop_stage(routed)
    clusters = components(nearest, "near-clusters")
    named = clusters.select(F.col("node").alias("_node"), F.col("root").alias("_cluster"))
    firsts = prints.groupBy("_node").agg(F.min("_id").alias("_id")).join(named, "_node")
    clustered = staged(_shingle_sets(docs, firsts, shingle), "near-sets")
    links_ = staged(cluster_links(clustered, block), "near-links")
    drop_stage(nearest, clusters, clustered)
    return links_


def _row_id() -> Column:
    """Stands for a row by its doc_id and text."""
    return F.concat(F.hex(content_key()), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


def keep_one(docs: DataFrame, shingle: int = 5, widest: int = WIDE_LINK, key_nodes: int = KEY_NODES, block: int = BLOCK_HASHES) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id.

    Texts whose sets of five-word shingles are alike by 0.8 or more are near copies; groups are what such
    links reach. Bands of least hashes and fingerprints of 256 bits only tell who is sent where, the sets of shingles
    decide. ``key_nodes`` and ``block`` bound what a task holds, not what is found. Texts may be of any length: a set
    larger than ``block`` is a block by itself. A null text counts as empty, and empty texts are copies of each other. Null doc_ids come last;
    rows alike in doc_id and text are copies of each other too.
    """
    prints = staged(_wide_prints(docs, shingle), "wide-prints")
    roots = components(similar_pairs(docs, prints, shingle, widest, key_nodes, block), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_id"))
    by_node = prints.groupBy("_node").agg(first.alias("_first"))
    rooted = by_node.join(roots, by_node["_node"] == roots["node"], "left").select(F.coalesce("root", "_node").alias("_root"), "_first")
    kept = rooted.groupBy("_root").agg(F.min("_first").alias("_first")).select(F.col("_first._id").alias("_id"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _row_id().alias("_id")).join(kept, "_id", "left_semi")
    once = Window.partitionBy("_id").orderBy(F.lit(1))
    return rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_row.*")
