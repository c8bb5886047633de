"""Document fingerprints against sets of shingles and a brute-force walk over the documents."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinscript.llm import sketches
from twinscript.llm.repeats import Powers

COLUMNS = ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "fingerprint", "edited_fingerprint")


def shingles(text):
    words = re.findall("[^ \t-\r]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def true_resemblance(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def walk(rows):
    """Every document with its edited and its next text."""
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        yield i, text, text[: len(text) - half] + after[:half], after


@pytest.mark.parametrize("range_bytes", [300, 64 * 2**20])
def test_every_row_meets_its_next(spark, frame, collect, odd_rows, monkeypatch, range_bytes):
    monkeypatch.setattr(sketches, "RANGE_BYTES", range_bytes)
    got = collect(sketches.fingerprints_beside_next(frame(odd_rows), size=100_000), *COLUMNS[:5])
    whole = [
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), true_resemblance(t, e), true_resemblance(t, after))
        for i, t, e, after in walk(odd_rows)
    ]
    assert got == sorted(whole, key=repr)


def test_fingerprints_belong_to_texts(spark, frame, collect, odd_rows):
    got = collect(sketches.fingerprints_beside_next(frame(odd_rows)), "edited_sha256", "n_chars", "fingerprint", "edited_fingerprint", "doc_id")
    texts = {i: t or "" for i, t, *_ in odd_rows if i not in (11, 12, None)}
    one = lambda t: sketches.written(sketches.text_sketches([t], Powers())[0])
    prints = {i: one(t) for i, t in texts.items()}
    assert all(prints[i] == fp for *_, fp, _, i in got if i in prints)
    assert prints[4] == prints[5] != prints[6] and prints[2] == prints[1] == ""
    edited = {hashlib.sha256(e.encode()).hexdigest(): one(e) for _, _, e, _ in walk(odd_rows)}
    assert all(edited[sha] == fp for sha, _, _, fp, _ in got)


@pytest.mark.parametrize("rows", [[], [(7, "a single document of six words", "en", "a")], [(None, None, None, None)]])
def test_small_tables(spark, frame, collect, rows):
    got = collect(sketches.fingerprints_beside_next(frame(rows)), "doc_id", "near_next")
    assert got == [(r[0], 1.0) for r in rows]


def test_equal_shingles_have_equal_hashes_only(spark):
    r = random.Random(2)
    texts = [" ".join(r.choices("ab", k=r.randint(0, 40))) for _ in range(60)] + ["", " \t ", "a b", "one\ntwo  three", "x " * 5000]
    hashes, sizes = sketches.shingle_hashes([t.encode() for t in texts], Powers())
    seen, at = {}, 0
    for t, n in zip(texts, sizes.tolist()):
        words = re.findall("[^ \t-\r]+", t)
        spelt = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        assert n == len(spelt)
        for s, h in zip(spelt, hashes[at : at + n].tolist()):
            assert seen.setdefault(s, h) == h
        at += n
    assert len(set(seen.values())) == len(seen)


def test_estimates_are_near_the_truth_and_exact_for_small_sets(spark):
    r = np.random.default_rng(4)
    draw = lambda n: np.unique(r.integers(0, sketches.SPACE, n).astype(np.uint64))
    for n in (20, 50_000):
        common, a, b = draw(n), draw(n), draw(n)
        a, b = np.union1d(common, a), np.union1d(common, b)
        true = n / (3 * n), 0.5, 3 * n
        size = 4096
        got = sketches.estimates(a[:size], b[:size], size)
        room = 1e-3 if n == 20 else 0.1
        assert all(abs(g - t) <= room * t for g, t in zip(got, true))
        assert sketches.resemblance(a[:size], b[:size], size) == got[0]


def test_merged_sketches_equal_the_sketch_of_all_parts(spark, frame):
    r = random.Random(8)
    words = [str(i) for i in range(40)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 60))), "en", r.choice(["hot"] * 5 + ["b", None])) for i in range(200)] + [(900, None, "en", "silent")]
    size = 64
    got = {x["source"]: x["sketch"] for x in sketches.merged(sketches.sketch_texts(frame(rows), ["source"], size=size), ["source"], size).collect()}
    assert got["silent"] == [] and len(got) == 4
    for source in ("hot", "b", None):
        hashes, _ = sketches.shingle_hashes([t.encode() for _, t, _, s in rows if s == source], Powers())
        assert got[source] == np.unique(hashes)[:size].astype(np.int64).tolist()


def test_columns_agree_with_numpy(spark):
    r = random.Random(3)
    some = lambda n: sorted(r.sample(range(500), n))
    pairs = [(some(a), some(b)) for a, b in ((0, 0), (0, 5), (5, 0), (20, 30), (64, 64), (64, 3), (3, 64), (63, 63))]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    got = [tuple(x) for x in df.select(*sketches.compared(F.col("a"), F.col("b"), 64)).collect()]
    want = [sketches.estimates(np.array(a, np.uint64), np.array(b, np.uint64), 64) for a, b in pairs]
    assert got == [pytest.approx(w) for w in want]
