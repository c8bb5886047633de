"""Spelling variants against a brute-force version over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from twinscript.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """Exactly one insertion, deletion or replacement, by trying them all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_force(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def drawn(seed, texts=250):
    r = random.Random(seed)
    stems = ["".join(r.choices("abé", k=r.randint(6, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÀÉaaaaÿz", "wordwordword" * 20]
    popular = r.choices(stems, k=4)

    def spelt():
        w = r.choice(popular) if r.random() < 0.7 else r.choice(stems)
        if r.random() < 0.2:
            i = r.randrange(len(w))
            w = w[:i] + r.choice(["", "x", "É", w[i] * 2]) + w[i + 1 :]
        return w.upper() if r.random() < 0.1 and w.isascii() else w

    rows = [(i, r.choice([" ", "-", "7", "\n"]).join(spelt() for _ in range(r.randint(1, 30)))) for i in range(texts)]
    return rows + [(None, rows[0][1]), (5, None), (6, ""), (7, "1 2 3"), rows[3], rows[3], (9, "longtext " * 20_000)]


@pytest.mark.parametrize("partition_words", [7, 60, 30_000])
def test_equals_brute_force_however_the_vocabulary_is_cut(spark, frame, collect, partition_words):
    rows = drawn(partition_words)
    docs = frame([(i, t, None, None) for i, t in rows])
    got = collect(spelling.spelling_variants(docs, partition_words=partition_words), *COLUMNS)
    assert got == brute_force(rows)
    assert any(w[1] for w in got) and max(w[4] for w in got) > 3


def test_pairs_of_one_acceptor_and_of_two(spark):
    import numpy as np

    r = random.Random(1)
    words = sorted({"".join(r.choices("ab", k=r.randint(7, 9))) for _ in range(150)})
    symbols = np.unique(spelling.code_points(words))
    for left, right in ((words, words), (words[::2], words[1::2])):
        a = spelling.Acceptor(left, symbols)
        b = a if left is right else spelling.Acceptor(right, symbols)
        i, j = spelling.one_edit_pairs(a, b)
        got = {frozenset((left[x], right[y])) for x, y in zip(i, j)}
        assert len(got) == len(i)
        assert got == {frozenset((x, y)) for x in left for y in right if x[:3] == y[:3] and one_edit(x, y)}


def test_acceptor_is_minimal(spark):
    import numpy as np

    words = [x + "ing" for x in ("walk", "talk", "work")]
    machine = spelling.Acceptor(sorted(words), np.unique(spelling.code_points(words)))
    # Of the 20 nodes of the tree, the common endings leave 10: start, after t/w, wo, wor, (w)a, (w)al, k, i, n, g.
    assert len(machine.final) == 10


def test_chains_of_forms_are_followed_to_the_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}", 1) for i in range(9)], "word string, form string, n int")
    assert {r["root"] for r in spelling.followed(forms, 9).collect()} == {"w9"}


def test_no_words(spark, frame):
    assert spelling.spelling_variants(frame([])).count() == 0
    assert spelling.spelling_variants(frame([(1, "few short words", None, None), (2, None, None, None)])).count() == 0
