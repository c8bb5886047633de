"""Best-two-fit packing of token ids into sequences of a fixed size.

Documents become token ids in Python, one pass over the table. A document longer than a
sequence is cut into full pieces and a rest. Pieces are dealt by a hash into shards of a
few thousand, and every shard is packed on its own, so no task ever sees more than a
shard, and a source that holds a third of the corpus is spread like any other.
"""

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.llm.tables import text_of

SEQUENCE_TOKENS = 2048
SHARD_DOCUMENTS = 8192  # each shard leaves at most a few sequences unfilled
CACHED_WORDS = 600_000
MARKS = ".,;:!?$%&*#|<>"  # symbols that form a token of their own behind letters
BLOCK_CHARS = 400_000  # small enough for a block's words to stay in the cache


class WordCache:
    """Token ids of whole texts from the ids of their blank-separated words.

    The vocabulary's pre-tokenizer never joins characters across white space, and it parts
    letters from the punctuation that follows. So the ids of a text are those of its words
    in a row, and a word needs encoding only once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.model = self.tokenizer.model
        suffix = getattr(self.model, "end_of_word_suffix", None)
        probes = ["the", "zebra", "qxj"]
        # Lower-case ASCII words pass the steps before the model unchanged; probes make sure of it.
        self.plain = bool(suffix) and all(self._of_model(p) == self._of_batch([p])[0] for p in probes)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab(True).values()) + 1, bool)
        if self.plain:
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _of_model(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _of_batch(self, words: list[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _of_line(self, words: list[str]) -> list[bytes]:
        """Words of letters alone, encoded as one text and parted where a token ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        if len(stops) != len(words):  # some letter becomes more than letters in lower case
            return self._of_batch(words)
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def _learn(self, words: list[str]) -> None:
        """Add words to the known ones: letters and the marks behind them apart, all else as it is."""
        known, parts, plain, other, rest = self.known, [], set(), set(), set()
        for w in words:
            stem = w.rstrip(MARKS)
            if self.plain and stem.isalpha():
                if stem.isascii():
                    stem = stem.lower()
                    if stem not in known:
                        plain.add(stem)
                elif stem not in known:
                    other.add(stem)
                if stem != w:
                    n = len(w) - len(stem)
                    mark = w[-n:] if n else ""
                    if mark not in known:
                        rest.add(mark)
                    parts.append((w, stem, mark))
            else:
                rest.add(w)
        for w in plain:
            known[w] = self._of_model(w)
        for group, encode in ((list(other), self._of_line), (list(rest), self._of_batch)):
            if group:
                known.update(zip(group, encode(group)))
        for w, stem, mark in parts:
            known[w] = known[stem] + known[mark]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        words = [t.replace("\n", " ").split(" ") for t in texts]
        seen = set().union(*words)
        if len(self.known) > CACHED_WORDS:
            self.known = {"": b""}
        known = self.known
        self._learn([w for w in seen if w not in known])
        known = known.__getitem__
        return [b"".join(map(known, w)) for w in words]


def blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``chars`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE_TOKENS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(tokenizer_path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in blocks(texts):
                rows = [], [], [], [], [], []
                for i, ids in enumerate(cache.ids(texts[lo:hi]), lo):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        for column, value in zip(rows, (i, n, at // 4, len(part) // 4, zlib.crc32(part), part)):
                            column.append(value)
                at, piece, start, length, crc, parts = rows
                out = [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, schema)


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length (1 to ``size``).

    A bin takes the largest unpacked length that fits until none does. If a gap stays, its
    smallest member gives way to the two unpacked lengths that fill the gap it leaves most,
    provided they fill more than it did.
    """
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=size + 1)
    first = np.concatenate([[0], np.cumsum(left)[:-1]])
    slots = np.arange(size + 1)
    below = np.maximum.accumulate(np.where(left > 0, slots, 0))  # the largest unpacked length up to x
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(length: int) -> int:
        left[length] -= 1
        item = order[first[length] + left[length]]
        if not left[length]:
            stop = length + 1
            while stop <= size and not left[stop]:
                stop += 1
            below[length:stop] = below[length - 1]
        return item

    def put_back(length: int) -> None:
        if not left[length]:
            stop = length + 1
            while stop <= size and not left[stop]:
                stop += 1
            below[length:stop] = length
        left[length] += 1

    todo, number = len(lengths), 0
    while todo:
        gap, members = size, []
        while gap and (length := int(below[gap])):
            members.append((length, take(length)))
            gap -= length
        if gap and len(members) > 1 and below[size]:
            smallest, item = members[-1]
            room = gap + smallest
            one = np.flatnonzero(left[: room + 1])
            two = below[room - one]
            two = np.where((two == one) & (left[one] < 2), below[np.maximum(one - 1, 0)], two)
            total = np.where(two > 0, one + two, 0)
            if len(total) and total[k := int(total.argmax())] > smallest:
                pair = [int(one[k]), int(two[k])]
                swapped = [(x, take(x)) for x in pair]
                members[-1:] = swapped
                # The place of the item in its length's list is free again; it goes there.
                put_back(smallest)
                order[first[smallest] + left[smallest] - 1] = item
        at = 0
        for length, item in members:
            bins[item], offsets[item] = number, at
            at += length
        todo -= len(members)
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, shards: int, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Add sequence_id and offset to pieces; rows of one shard are packed together."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start"], kind="stable", ignore_index=True)
        bins, offsets = best_two_fit(rows["length"].to_numpy(np.int64), size)
        return rows.assign(sequence_id=(rows["_shard"].to_numpy(np.int64) << 32) + bins, offset=offsets).drop(columns="_shard")

    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.withColumn("_shard", shard).groupBy("_shard").applyInPandas(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE_TOKENS, shard_documents: int = SHARD_DOCUMENTS, with_ids: bool = False
) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    A null text counts as empty; an empty text is the single end id. Repeated rows and null
    doc_ids are packed like any others. Equal lengths are taken in the order of doc_id and piece.
    An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    shards = max(1, -(-docs.count() // shard_documents))
    return pack(token_pieces(docs, tokenizer_path, size, with_ids=with_ids), shards, size)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences: ids of all members in place order, at most one sequence size each."""
    placed = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(placed, lambda p: p["ids"])).alias("ids"))
