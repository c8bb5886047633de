"""Spelling variants by finite-state composition.

1. Words are counted where the texts are read; only words and counts are shuffled.
2. The vocabulary is cut by initial states: a partition holds the words that begin with some
   keys of ``KEY`` code points, another family of partitions the reversed words. Two words of
   ``2 * KEY + 1`` code points or more that differ by one edit begin alike or end alike by a
   whole key, so one of the two families has both in one partition.
3. Of each partition the minimal acceptor A is built and A o T o A enumerated from the states
   behind the keys on, T being the transducer that makes exactly one edit. States that accept
   the same endings are one state, and an accepted path is a pair of words.
4. A key with more words than a partition holds is cut into blocks by a hash of the word, and
   blocks meet two at a time (A o T o B) in groups of their own.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.llm.tables import staged, text_of

KEY = 3
LEAST_LENGTH, LEAST_COUNT, RATIO, DROP_ONE_IN = 7, 2, 10, 31
COUNTED_WORDS = 400_000  # in a task before they are handed on
PARTITION_WORDS = 30_000
EDITED = 1_000_000  # composed states expanded at once


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """``word`` and its number of occurrences ``n``, after the slips that the hash of document and run makes."""
    runs = re.compile(rf"[a-zÀ-ÿ]{{{least_length},}}")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # The lower case of bytes leaves all but A-Z alone.
                text = text.as_buffer().to_pybytes().lower().decode("utf-8", "surrogatepass")
                start = zlib.crc32(f"{doc}:".encode())
                for run, times in Counter(m[0] for m in runs.finditer(text)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % drop_one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    totals[run] += times
                if len(totals) > COUNTED_WORDS:
                    yield rows()
                    totals.clear()
        yield rows()

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(doc.alias("doc_id"), text_of().alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acceptor of sorted words, with the number of words below each state.

    ``first[s]:first[s + 1]`` are the arcs of state ``s``, ordered by symbol; ``skip`` counts the words
    that precede those of an arc, so the sum of skips along a path is the rank of its word.
    """

    def __init__(self, words: list[str], symbols: np.ndarray):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.searchsorted(symbols, code_points(words))
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        parents, labels, nodes, ends = [], [], 1, np.zeros(1, bool)
        ends[0] = bool(len(lengths)) and bool((lengths == 0).any())
        node = np.zeros(len(words), np.int64)
        live, depth = np.flatnonzero(lengths > 0), 0
        while len(live):
            symbol, parent = codes[at[live] + depth], node[live]
            new = np.ones(len(live), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])
            node[live] = nodes - 1 + np.cumsum(new)
            parents.append(parent[new])
            labels.append(symbol[new])
            nodes += int(new.sum())
            depth += 1
            done = lengths[live] == depth
            ends = np.concatenate([ends, np.zeros(nodes - len(ends), bool)])
            ends[node[live[done]]] = True
            live = live[~done]
        self._merge(np.concatenate(parents) if parents else np.zeros(0, np.int64), np.concatenate(labels) if labels else np.zeros(0, np.int64), ends.tolist())
        self.symbols = len(symbols)

    def _merge(self, parents: np.ndarray, labels: np.ndarray, ends: list[bool]) -> None:
        """One state for all nodes with the same endings. Node k + 1 is the child of arc k, so children come behind parents."""
        first = np.searchsorted(parents, np.arange(len(ends) + 1)).tolist()
        labels = labels.tolist()
        state, known = [0] * len(ends), {}
        starts, symbol, to, skip, final, count = [0], [], [], [], [], []
        for v in range(len(ends) - 1, -1, -1):
            a, b = first[v], first[v + 1]
            key = (ends[v], labels[a], state[a + 1]) if b == a + 1 else (ends[v], *labels[a:b], *state[a + 1 : b + 1])
            s = known.get(key)
            if s is None:
                s = known[key] = len(final)
                below = int(ends[v])
                for k in range(a, b):
                    child = state[k + 1]
                    symbol.append(labels[k])
                    to.append(child)
                    skip.append(below)
                    below += count[child]
                starts.append(len(to))
                final.append(ends[v])
                count.append(below)
            state[v] = s
        self.start = state[0]
        self.first, self.symbol, self.to, self.skip = (np.array(x, np.int64) for x in (starts, symbol, to, skip))
        self.final = np.array(final, bool)

    def arcs_by_symbol(self) -> np.ndarray:
        """``[state, symbol]``: the arc, or -1."""
        table = np.full((len(self.final), max(1, self.symbols)), -1, np.int32)
        table[np.repeat(np.arange(len(self.final)), np.diff(self.first)), self.symbol] = np.arange(len(self.to))
        return table


def code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


def _fan(first: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All arcs of the given states: which of the states, and the arc."""
    n = first[states + 1] - first[states]
    which = np.repeat(np.arange(len(states)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[states][which]


def one_edit_pairs(a: Acceptor, b: Acceptor, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the words of ``a`` and ``b`` that one edit behind their first ``key`` code points tells apart.

    For a single acceptor (``a is b``) each pair comes once, in one of its two orders. An edit within a run
    of equal code points is accepted at several places; the pair still comes once.
    """
    same, by_a, by_b = a is b, a.arcs_by_symbol(), None
    by_b = by_a if same else b.arcs_by_symbol()
    found = []

    def step(p, q, i, j):
        """Both read the same symbol."""
        which, arc = _fan(a.first, p)
        other = by_b[q[which], a.symbol[arc]]
        ok = other >= 0
        which, arc, other = which[ok], arc[ok], other[ok]
        return a.to[arc], b.to[other], i[which] + a.skip[arc], j[which] + b.skip[other]

    def follow(edited):
        """All pairs that the composition accepts once its edit is made."""
        while len(edited[0]):
            p, q, i, j = edited
            hit = a.final[p] & b.final[q]
            if hit.any():
                found.append((i[hit], j[hit]))
            edited = step(p, q, i, j)

    equal = tuple(np.array([x], np.int64) for x in (a.start, b.start, 0, 0))
    depth = 0
    while len(equal[0]):
        if depth >= key:
            for at in range(0, len(equal[0]), EDITED // 64):
                p, q, i, j = (x[at : at + EDITED // 64] for x in equal)
                which, arc = _fan(a.first, p)  # only the left word reads: a deletion
                follow((a.to[arc], q[which], i[which] + a.skip[arc], j[which]))
                if not same:
                    back, other = _fan(b.first, q)
                    follow((p[back], b.to[other], i[back], j[back] + b.skip[other]))
                pair, other = _fan(b.first, q[which])  # each reads a symbol of its own: a replacement
                unlike = a.symbol[arc[pair]] < b.symbol[other] if same else a.symbol[arc[pair]] != b.symbol[other]
                pair, other = pair[unlike], other[unlike]
                left = arc[pair]
                follow((a.to[left], b.to[other], i[which[pair]] + a.skip[left], j[which[pair]] + b.skip[other]))
        equal = step(*equal)
        depth += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found))
    both = np.unique(np.stack([i, j], 1), axis=0)
    return both[:, 0], both[:, 1]


def near_in_partition(words: list[str], n: np.ndarray, block: np.ndarray, backward: bool, key: int = KEY) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """For each word with a near word in the partition: the word, how many, the one of largest count, its count.

    Two ``block`` numbers mean that only pairs between the blocks are wanted. The backward family leaves out the
    pairs that begin alike, which the forward one has.
    """
    spelt = [w[::-1] for w in words] if backward else words
    order = np.array(sorted(range(len(words)), key=spelt.__getitem__), np.int64)
    symbols = np.unique(code_points(words))
    parts = [order[block[order] == x] for x in np.unique(block)]
    machines = [Acceptor([spelt[x] for x in part.tolist()], symbols) for part in parts]
    i, j = one_edit_pairs(machines[0], machines[-1], key)
    i, j = parts[0][i], parts[-1][j]
    if backward:
        begin = np.unique([w[:key] for w in words], return_inverse=True)[1]
        i, j = i[begin[i] != begin[j]], j[begin[i] != begin[j]]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    one, other = np.concatenate([i, j]), np.concatenate([j, i])
    best = np.lexsort((rank[other], -n[other], one))
    one, other = one[best], other[best]
    heads = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.zeros(0, np.int64)
    at = one[heads]
    sizes = np.diff(np.concatenate([heads, [len(one)]]))
    return [words[x] for x in at.tolist()], sizes, [words[x] for x in other[heads].tolist()], n[other[heads]]


def near_words(vocabulary: DataFrame, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """``word``, ``n_near`` and its near word of largest count ``form`` with ``form_n``, for words with a near word.

    ``vocabulary`` has distinct ``word`` of ``2 * KEY + 1`` code points or more, and ``n``.
    """
    rows = vocabulary.agg(F.count("*")).first()[0]
    bins = max(1, -(-2 * rows // partition_words))
    begin, end = F.substring("word", 1, KEY), F.expr(f"right(word, {KEY})")
    family = F.explode(F.array(F.struct(F.lit(False).alias("back"), begin.alias("key")), F.struct(F.lit(True).alias("back"), end.alias("key"))))
    keyed = vocabulary.select("word", "n", family.alias("_f")).select("word", "n", F.col("_f.back").alias("_back"), F.col("_f.key").alias("_key"))
    # Keys with more words than a partition holds: no more of them than there are partitions.
    crowded = keyed.groupBy("_back", "_key").agg(F.count("*").alias("_words")).filter(F.col("_words") > partition_words)
    crowded = crowded.select("_back", "_key", F.ceil(F.col("_words") / partition_words).cast("int").alias("_blocks"))
    placed = keyed.join(F.broadcast(staged(crowded, "crowded-keys")), ["_back", "_key"], "left")
    own = F.when(F.col("_blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("word"), F.col("_blocks"))).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_blocks") - 1, F.lit(0))))
    placed = placed.withColumn("_own", own).withColumn("_other", meets).select(
        "word", "n", "_own", "_back",
        F.when(F.col("_blocks").isNull(), F.pmod(F.xxhash64("_key"), F.lit(bins))).alias("_bin"),
        F.when(F.col("_blocks").isNotNull(), F.col("_key")).alias("_hot"),
        F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"),
    )

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        back, i, j = key[0].as_py(), key[3].as_py(), key[4].as_py()
        words, block = table.column("word").to_pylist(), table.column("_own").to_numpy()
        if i != j and (block == block[0]).all():
            words, block, table = [], block[:0], table.slice(0, 0)
        found = near_in_partition(words, table.column("n").to_numpy(), block, back) if words else ([], np.zeros(0, np.int64), [], np.zeros(0, np.int64))
        kinds = pa.string(), pa.int64(), pa.string(), pa.int64()
        return pa.table([pa.array(c, k) for c, k in zip(found, kinds)], names=["word", "n_near", "form", "form_n"])

    parts = placed.groupBy("_back", "_bin", "_hot", "_i", "_j").applyInArrow(compose, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("_best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("_best.form").alias("form"), (-F.col("_best.less")).alias("form_n"))


def followed(forms: DataFrame, hops: int) -> DataFrame:
    """``word`` and ``root``, the last word that ``form`` after ``form`` leads to; no chain is longer than ``hops``.

    Each round doubles the distance looked ahead.
    """
    roots, ahead = forms.select("word", F.col("form").alias("root")), 1
    while ahead < hops:
        roots = staged(roots, "spelling-roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        ahead *= 2
    return roots


def spelling_variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
    drop_one_in: int = DROP_ONE_IN, partition_words: int = PARTITION_WORDS,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs ``least_count`` times.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; where ``drop_one_in`` divides the hash
    of document and run, the run loses a code point first. A word's ``form`` is its near word (one edit away) of
    largest count, if that is ``ratio`` times its own; ``root`` is where forms lead in the end.

    A null text has no words; a null doc_id counts as the empty text. Repeated rows count again. Ties between near
    words go to the smallest in code-point order. Texts and words may be of any length. An empty table, or one
    without such words, gives an empty result. Columns besides doc_id and text are not read.
    """
    if least_length < 2 * KEY + 1 or ratio < 2:
        raise ValueError(f"words need {2 * KEY + 1} code points for a shared key, and forms at least twice the count")
    words = staged(word_counts(docs, least_length, drop_one_in).filter(F.col("n") >= least_count), "vocabulary")
    near = staged(near_words(words, partition_words), "near-words")
    known = words.join(near, "word", "left").withColumn("_is", F.col("form_n") >= ratio * F.col("n"))
    table = staged(
        known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_is"), F.col("form")).alias("form"), F.when(F.col("_is"), F.col("form_n")).alias("form_n")),
        "forms",
    )
    # Counts grow by ``ratio`` from form to form, which bounds the number of steps.
    reach, hops = table.agg(F.max("form_n")).first()[0] or 0, 0
    while reach >= least_count * ratio:
        reach, hops = reach // ratio, hops + 1
    roots = followed(table.filter(F.col("form").isNotNull()), max(hops, 1))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_sql() -> str:
    """The same in SQL: checksums bit by bit, near words by equal rests after taking a code point out."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{upper}', '{lower}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
bytes AS (
  SELECT *, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END)) AS b
  FROM counted),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda h, x:
    list_reduce([xor(h, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) AS h
  FROM bytes),
slipped AS (
  SELECT CASE WHEN h % {DROP_ONE_IN} = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
places AS MATERIALIZED (SELECT word, unnest(range(length(word))) AS i FROM words),
rests AS MATERIALIZED (SELECT word, i, left(word, i) AS a, substr(word, i + 2) AS z FROM places),
pairs AS (
  SELECT DISTINCT p.word, q.word AS other FROM rests p JOIN rests q ON p.i = q.i AND p.a = q.a AND p.z = q.z AND p.word <> q.word
  UNION SELECT r.word, w.word FROM rests r JOIN words w ON r.a || r.z = w.word
  UNION SELECT w.word, r.word FROM rests r JOIN words w ON r.a || r.z = w.word),
best AS (
  SELECT p.word, count(*) AS n_near, max(o.n) AS most, (list(o.word ORDER BY o.n DESC, o.word))[1] AS most_word
  FROM pairs p JOIN words o ON p.other = o.word GROUP BY p.word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * w.n THEN most_word END AS form, CASE WHEN most >= {RATIO} * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word AND f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON c.at = f.word AND f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
