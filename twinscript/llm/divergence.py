"""How far the sources of a language differ in their words, by sorting pointers to token starts.

1. Over the Arrow buffer of a block of texts every start of a term becomes a pointer. Pointers are dealt
   into one slice per language and sorted by multikey quicksort, seven bytes as one character: a slice is
   sorted by the bytes at its depth, and runs of equal bytes are slices of the next depth. No term is
   copied before its run is known.
2. A run of equal terms gives the occurrences and documents of a term by source. Only these are shuffled.
3. Terms in few documents of a language go. What is left, in exact whole numbers, gives every group's
   rates, the terms a source favours, and the distance of any two sources of a language, the latter in
   slices of terms whose partial sums are added up.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.llm.tables import staged, text_of

LEAST_DOCUMENTS, SMOOTHING, SCALE_STEPS, TOP_TERMS = 30, 5, 3, 50
CHARACTER = 7  # bytes compared at once; the eighth tells whether a term goes on
BLOCK_BYTES = 16 * 2**20
FEW_SLICES = 64
CELLS = 2_000_000  # terms x sources of a slice, and of what is filled in at once
SLICE_TERMS = 4_096
SOURCES_AT_ONCE = 1_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_TERM = np.zeros(256, bool)
IN_TERM[97:123] = IN_TERM[128:] = True


def token_pointers(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of all terms in lower-cased bytes; none crosses a text's end (``cuts``: offsets of the texts)."""
    inside = IN_TERM[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    first = cuts[:-1][cuts[:-1] < cuts[1:]]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    last = cuts[1:][cuts[:-1] < cuts[1:]] - 1
    after[last] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def equal_runs(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the pointers of each slice: the run of every pointer, and a pointer of every run."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    run, heads, runs, depth = np.empty(len(starts), np.int64), [], 0, 0
    pointers = np.argsort(slices, kind="stable")
    part = slices[pointers]
    while len(pointers):
        left = stops[pointers] - starts[pointers] - depth
        key = eight[starts[pointers] + depth].astype(np.uint64)
        unused = np.uint64(8) * (np.uint64(8) - np.minimum(left, CHARACTER).astype(np.uint64))
        key = (key >> unused << unused) | (left > CHARACTER).astype(np.uint64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        if len(cuts) < FEW_SLICES:
            edges = [0, *cuts.tolist(), len(part)]
            order = np.concatenate([a + np.argsort(key[a:b]) for a, b in zip(edges, edges[1:])])
        else:
            order = np.lexsort((key, part))
        pointers, key, part, left = pointers[order], key[order], part[order], left[order]
        new = np.ones(len(pointers), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(new)))
        settled = (left[first] <= CHARACTER) | (sizes == 1)
        number = np.cumsum(settled) - 1 + runs
        group = np.repeat(np.arange(len(first)), sizes)
        done = settled[group]
        run[pointers[done]] = number[group[done]]
        heads.append(pointers[first[settled]])
        runs += int(settled.sum())
        pointers, part, depth = pointers[~done], group[~done], depth + CHARACTER
    return run, np.concatenate(heads) if heads else np.zeros(0, np.int64)


def strings_at(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The bytes of each range as a string."""
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, stops - starts)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[at])).cast(pa.string())


def _block_counts(data: np.ndarray, cuts: np.ndarray, langs: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms with group, occurrences and documents, of a block of texts."""
    data = LOWER[data]
    starts, stops = token_pointers(data, cuts)
    doc = np.searchsorted(cuts, starts, side="right") - 1
    run, heads = equal_runs(data, starts, stops, langs[doc])
    # Pointers of a run by document, then the documents by group.
    by_doc, n = np.unique(run * len(langs) + doc, return_counts=True)
    width = int(groups.max()) + 1 if len(groups) else 1
    cell, at, docs = np.unique(by_doc // len(langs) * width + groups[by_doc % len(langs)], return_inverse=True, return_counts=True)
    total = np.bincount(at, n, len(cell)).astype(np.int64)
    which = heads[cell // width]
    return strings_at(data, starts[which], stops[which]), cell % width, total, docs


def source_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term with the occurrences ``n`` and documents ``docs``; the empty term stands for the group itself."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lang, source, text = (batch.column(k) for k in range(3))
            pair = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
            numbers: dict[tuple[str, str], int] = {}
            groups = np.array([numbers.setdefault((x["lang"], x["source"]), len(numbers)) for x in pair.to_pylist()], np.int64)
            names = list(numbers)
            lang_number: dict[str, int] = {}
            lang_of = np.array([lang_number.setdefault(x, len(lang_number)) for x, _ in names], np.int64)

            def rows(terms, group, n, many):
                group = pa.array(group, pa.int64())
                sides = [pa.array([x[k] for x in names], pa.string()).take(group) for k in range(2)]
                return pa.RecordBatch.from_arrays([*sides, terms, pa.array(n, pa.int64()), pa.array(many, pa.int64())], ["lang", "source", "term", "n", "docs"])

            each = np.arange(len(names))
            yield rows(pa.array([""] * len(names), pa.string()), each, 0 * each, 0 * each)
            text = text.cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, side="right")) - 1)
                a, b = int(offsets[lo]), int(offsets[hi])
                if b - a <= 2 * BLOCK_BYTES:
                    yield rows(*_block_counts(data[a:b], offsets[lo : hi + 1] - a, lang_of[groups[lo:hi]], groups[lo:hi]))
                else:
                    # One very long text: pieces that end between terms, added up so that it counts as one document.
                    total: dict[str, int] = {}
                    while a < b:
                        stop = min(b, a + BLOCK_BYTES)
                        while stop < b and IN_TERM[LOWER[data[stop]]]:
                            stop += 1
                        terms, _, n, _ = _block_counts(data[a:stop], np.array([0, stop - a]), np.zeros(1, np.int64), np.zeros(1, np.int64))
                        for term, k in zip(terms.to_pylist(), n.tolist()):
                            total[term] = total.get(term, 0) + k
                        a = stop
                    ones = np.ones(len(total), np.int64)
                    yield rows(pa.array(list(total), pa.string()), groups[lo] * ones, np.array(list(total.values()), np.int64), ones)
                lo = hi

    texts = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    counted = texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def rate(n: Column, whole: Column) -> Column:
    """1 + floor(10^9 * n / whole) in whole numbers: three decimal places at a time, so that nothing overflows."""
    out, rest = F.lit(1).cast("long"), n
    for step in range(SCALE_STEPS):
        rest = rest * 1000
        out = out + F.call_function("div", rest, whole) * 1000 ** (SCALE_STEPS - 1 - step)
        rest = rest % whole
    return out


def _rates(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    out, rest = np.ones(n.shape, np.int64), n
    for step in range(SCALE_STEPS):
        rest = rest * 1000
        out += rest // whole * 1000 ** (SCALE_STEPS - 1 - step)
        rest = rest % whole
    return out


def kept_terms(counts: DataFrame, least_documents: int) -> tuple[DataFrame, DataFrame]:
    """The counts of the terms in enough documents of their language, and the sizes of all groups.

    Sizes are ``n_group`` and ``n_lang`` (occurrences of kept terms), ``n_terms`` of the language and its ``n_sources``.
    """
    of_term = Window.partitionBy("lang", "term")
    table = counts.withColumns({"all_docs": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term), "least": F.min("source").over(of_term)})
    table = table.filter((F.col("term") == "") | (F.col("all_docs") >= least_documents))
    table = staged(table.select("lang", "source", "term", "n", "all_n", (F.col("least") == F.col("source")).alias("leads")), "source-terms")
    own = F.sum(F.when((F.col("term") != "") & F.col("leads"), 1).otherwise(0)).alias("terms")
    groups = table.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), own)
    of_lang = Window.partitionBy("lang")
    sizes = groups.select(
        "lang", "source", "n_group", F.sum("n_group").over(of_lang).alias("n_lang"), F.sum("terms").over(of_lang).alias("n_terms"), F.count("*").over(of_lang).alias("n_sources")
    )
    return table.filter("term <> ''").drop("leads"), staged(sizes, "source-sizes")


def favoured_terms(terms: DataFrame, sizes: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The ``top`` terms of each group by how far its rate lies above its language's."""
    whole = lambda n: F.col(n) + SMOOTHING * F.col("n_terms")
    known = terms.filter("n > 0").join(sizes, ["lang", "source"])
    known = known.withColumn("value", rate(F.col("n") + SMOOTHING, whole("n_group")) - rate(F.col("all_n") + SMOOTHING, whole("n_lang")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = known.filter("value > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _slice_distances(key: tuple, terms: pa.Table, sizes: pa.Table) -> pa.Table:
    """Sums of the differences of rates over a slice's terms, for pairs of sources whose first is in the slice's block."""
    lang, _, block = (k.as_py() for k in key)
    empty = pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.int64())], names=["lang", "a", "b", "value"])
    sizes = sizes.sort_by("source")
    names = sizes.column("source").to_pylist()
    whole = sizes.column("n_group").to_numpy() + SMOOTHING * sizes.column("n_terms").to_numpy()
    first, stop = block * SOURCES_AT_ONCE, min(len(names), (block + 1) * SOURCES_AT_ONCE)
    sums = np.zeros((stop - first, len(names)), np.int64)
    if len(terms):
        place = {s: i for i, s in enumerate(names)}
        column = np.array([place[s] for s in terms.column("source").to_pylist()], np.int64)
        row = terms.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        n, order = terms.column("n").to_numpy(), np.argsort(row, kind="stable")
        row, column, n = row[order], column[order], n[order]
        height = max(1, CELLS // len(names))
        for low in range(0, int(row[-1]) + 1, height):
            a, b = np.searchsorted(row, [low, low + height])
            counts = np.zeros((min(height, int(row[-1]) + 1 - low), len(names)), np.int64)
            counts[row[a:b] - low, column[a:b]] = n[a:b]
            rates = _rates(counts + SMOOTHING, whole).T.copy()
            for x in range(first, stop):
                sums[x - first, x + 1 :] += np.abs(rates[x + 1 :] - rates[x]).sum(1)
    elif key[1].as_py() != 0:
        return empty
    x, y = np.nonzero(np.arange(len(names))[None, :] > np.arange(first, stop)[:, None])
    name = pa.array(names, pa.string())
    columns = [pa.array([lang] * len(x), pa.string()), name.take(pa.array(x + first)), name.take(pa.array(y)), pa.array(sums[x, y], pa.int64())]
    return pa.table(columns, names=empty.column_names)


def source_distances(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every other source of the language for each group, farthest first.

    Two sources differ in terms that neither has too, since their smoothed rates differ; so a slice of terms is met
    with all sources of the language, a bounded number of terms and cells at a time.
    """
    slices = F.greatest(F.lit(1), F.ceil(F.col("n_terms") * F.col("n_sources") / CELLS), F.ceil(F.col("n_terms") / SLICE_TERMS))
    blocks = F.ceil(F.col("n_sources") / SOURCES_AT_ONCE)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    sized = sizes.withColumn("_slices", slices).withColumn("_blocks", blocks)
    sides = sized.withColumn("_slice", every(F.col("_slices"))).withColumn("_block", every(F.col("_blocks")))
    met = terms.join(sized.select("lang", "source", "_slices", "_blocks"), ["lang", "source"])
    met = met.withColumn("_slice", F.pmod(F.xxhash64("term"), "_slices")).withColumn("_block", every(F.col("_blocks")))
    keys = ["lang", "_slice", "_block"]
    parts = met.select(*keys, "source", "term", "n").groupBy(*keys).cogroup(sides.select(*keys, "source", "n_group", "n_terms").groupBy(*keys))
    sums = parts.applyInArrow(_slice_distances, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = sums.select("lang", ways.alias("_w"), "value").select("lang", "_w.source", F.lit("pair").alias("part"), "_w.item", "value")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the distance to each other source (``pair``) and the favoured terms (``term``).

    Null lang, source and text count as empty. Terms are runs of ASCII letters and of all code points beyond ASCII, A-Z
    in lower case; a language keeps those in ``least_documents`` of its documents, rows being documents and repeated
    rows counting again. Ties go to the smaller item by its bytes. A group without any kept term has equal rates for
    all of them; a language without kept terms has distances of zero; a single source has no pair. Texts and terms may
    be of any length. An empty table gives an empty result. Other columns are not read.
    """
    terms, sizes = kept_terms(source_counts(docs), least_documents)
    return source_distances(terms, sizes).unionByName(favoured_terms(terms, sizes, top))


def divergence_sql() -> str:
    """The same in SQL over the full grid of groups and kept terms."""
    rate_of = "CAST(1 + (1000000000::HUGEINT * ({n} + 5)) // ({whole} + 5 * v) AS BIGINT)"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tokens AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM tokens GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS all_n FROM counts GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(all_n) AS n_lang FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT g.lang, g.source, k.term, k.all_n, coalesce(c.n, 0) AS n, l.v, l.n_lang, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS n_group
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
rates AS MATERIALIZED (SELECT lang, source, term, n, {rate_of.format(n='n', whole='n_group')} AS p, {rate_of.format(n='all_n', whole='n_lang')} AS q FROM grid),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, CAST(0 AS BIGINT) FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM langs)),
listed AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM rates WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM listed)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
