"""Substring deduplication over words by difference-cover anchors.

Words are hashed, and so are windows of ``anchor`` words, but only at cover positions: those
whose index modulo the period lies in a difference cover. For any two places some shift below
the period brings both to a cover position, so two equal windows of ``period - 1 + anchor``
words share an aligned anchor. Anchors that occur twice are extended: every full window around
one is hashed again with 95 bits, and windows that occur twice mark their words.
"""

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.llm import repeats
from twinscript.llm.packing import blocks
from twinscript.llm.repeats import Powers, Rolling, found_elsewhere, gathered, mix, occurrence_rows, offsets_of, text_store
from twinscript.llm.tables import text_of
from twinscript.operators.joins import join_hot

PERIOD = 21
COVER = [3, 6, 7, 12, 14]  # every difference modulo 21 occurs between two of these
WINDOW = 35
BLOCK_CHARS = 2_000_000
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


@dataclass
class Words:
    """The words of several texts in a row: their bytes, hashes, and each text's range."""

    data: bytes
    starts: np.ndarray
    stops: np.ndarray
    first: np.ndarray  # of each text, and the total at the end
    hashes: np.ndarray


def words_of(texts: list[str], powers: Powers, lower: bool = False) -> Words:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(raw) + b" "
    if lower:
        data = data.lower()  # ASCII letters alone, as bytes have no others
    buffer = np.frombuffer(data, np.uint8)
    inside = ~SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    first = np.searchsorted(starts, begin)
    hashes = Rolling(buffer.astype(np.uint64) + np.uint64(1), powers).of(starts, stops)
    return Words(data, starts, stops, first, hashes)


def _anchors(words: Words, ids: np.ndarray, window: int, anchor: int) -> pa.RecordBatch:
    powers = Powers()
    count = np.diff(words.first)
    owner = np.repeat(np.arange(len(count)), count)
    index = np.arange(len(owner)) - words.first[owner]
    cover = np.zeros(PERIOD, bool)
    cover[COVER] = True
    at = np.flatnonzero(cover[index % PERIOD] & (count[owner] >= window) & (index + anchor <= count[owner]))
    h = Rolling(words.hashes, powers).of(at, at + anchor)
    return occurrence_rows(h, None, ids[owner[at]], index[at])


def _windows(words: Words, ids: np.ndarray, copied: np.ndarray, places: list[np.ndarray], window: int) -> pa.RecordBatch:
    powers = Powers()
    at, owner = [], []
    for t, p in enumerate(places):
        last = words.first[t + 1] - words.first[t] - window
        marks = np.zeros(last + 1 + PERIOD, np.int32)
        low = np.clip(p - PERIOD + 1, 0, last + 1)
        np.add.at(marks, low, 1)
        np.add.at(marks, np.clip(p + 1, 0, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(marks)[: last + 1] > 0)
        at.append(starts)
        owner.append(np.full(len(starts), t))
    at, owner = np.concatenate(at), np.concatenate(owner)
    place = at + words.first[owner]
    h = Rolling(words.hashes, powers).of(place, place + window)
    check = Rolling(mix(words.hashes ^ np.uint64(0x5BF03635)), powers).of(place, place + window)
    return occurrence_rows(h, check, ids[owner], at, copied[owner])


def _kept(words: Words, t: int, starts: np.ndarray | None, window: int) -> tuple[int, np.ndarray]:
    """Number of words of text ``t`` and which of them stay; no starts at all means every window repeats."""
    n = int(words.first[t + 1] - words.first[t])
    if starts is None:
        return n, np.full(n, n < window)
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return n, np.cumsum(marks)[:n] == 0


def deduplicated_texts(docs: DataFrame, window: int = WINDOW, repeats_only: bool = False) -> DataFrame:
    """Per distinct text: ``_id``, ``_key``, n_words, n_removed, the kept text (words joined by one
    space, null if no word goes), its kept_sha256, and the removed runs of words.

    With ``repeats_only``, texts that occur once and hold no repeated window have no row."""
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"a window needs {PERIOD} words at least")
    store = text_store(docs)
    size = store.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // repeats.STORE_BYTES))

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for lo, hi in blocks(texts, BLOCK_CHARS):
                yield _anchors(words_of(texts[lo:hi], powers), ids[lo:hi], window, anchor)

    seen = store.select("_id", "text").mapInArrow(anchors, "h long, x long, _id long")
    candidates = gathered(found_elsewhere(seen, width))

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, copied, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy() > 1, batch.column(2).to_pylist()
            values, at = offsets_of(batch.column(3))
            for lo, hi in blocks(texts, BLOCK_CHARS):
                places = [values[at[t] : at[t + 1]].astype(np.int64) for t in range(lo, hi)]
                yield _windows(words_of(texts[lo:hi], powers), ids[lo:hi], copied[lo:hi], places, window)

    around = store.join(candidates, "_id").select("_id", "copies", "text", "_places")
    repeated = gathered(found_elsewhere(around.mapInArrow(windows, "h long, x long, _id long"), width))

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            copied, texts = batch.column(2).to_numpy() > 1, batch.column(3).to_pylist()
            values, at = offsets_of(batch.column(4))
            for lo, hi in blocks(texts, BLOCK_CHARS):
                words = words_of(texts[lo:hi], powers)
                rows = []
                for t in range(lo, hi):
                    own = None if copied[t] else values[at[t] : at[t + 1]].astype(np.int64)
                    n, stays = _kept(words, t - lo, own, window)
                    place = np.flatnonzero(stays) + words.first[t - lo]
                    kept = b" ".join([words.data[a:b] for a, b in zip(words.starts[place].tolist(), words.stops[place].tolist())])
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], stays, [True]]).astype(np.int8)))
                    runs = [{"start": a, "words": b - a} for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist())]
                    gone = n - len(place)
                    rows.append((n, gone, kept.decode("utf-8", "surrogatepass") if gone else None, hashlib.sha256(kept).hexdigest(), runs))
                n, gone, kept, sha, runs = zip(*rows)
                part = batch.slice(lo, hi - lo)
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())]
                columns.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_key", "n_words", "n_removed", "kept", "kept_sha256", "removed"])

    schema = "_id long, _key binary, n_words long, n_removed long, kept string, kept_sha256 string, removed array<struct<start: int, words: int>>"
    judged = store.join(repeated, "_id", "left").select("_id", "_key", "copies", "text", "_places")
    if repeats_only:
        judged = judged.filter("copies > 1 OR _places IS NOT NULL")
    return judged.mapInArrow(remove, schema)


def _with_results(docs: DataFrame, results: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Results of a text to each of its rows; a text may fill any share of them."""
    keys = docs.withColumns({"_of": F.concat(F.hex(repeats.content_key()), F.hex(repeats.content_id()))})
    side = results.select(F.concat(F.hex("_key"), F.hex("_id")).alias("_of"), *columns)
    return join_hot(keys, side, "_of", how).drop("_of")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed runs of every document.

    A null text has no words. Words are the text's own, parted by ASCII white space. A text that
    occurs in several rows repeats as a whole, so each of its rows loses all its words if it has a
    window. Null doc_ids and repeated rows stay rows; an empty table gives an empty result.
    Columns besides doc_id and text are not read.
    """
    results = deduplicated_texts(docs, window)
    return _with_results(docs.select("doc_id", "text"), results, "n_words", "n_removed", "kept_sha256", "removed").drop("text")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages taken out of their texts; a document of which no word is left goes."""
    results = deduplicated_texts(docs, window, repeats_only=True)
    struct = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    joined = _with_results(struct, results, "n_words", "n_removed", "kept", how="left")
    # A text without a result loses nothing: it stays if it has a word at all.
    rows = joined.filter(F.coalesce(F.col("n_words") > F.col("n_removed"), text_of("_row.text").rlike("[^\\x20\\x09-\\x0D]")))
    columns = [F.coalesce("kept", F.col("_row.text")).alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return rows.select(*columns)


def substring_sql(window: int = WINDOW) -> str:
    """The same removals for the check, over the windows' words themselves."""
    return f"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + {window - 1}], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {window} + 2)) AS i FROM rows)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {window})) AS p FROM twice),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM rows),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM rows LEFT JOIN kept USING (rid)
"""
