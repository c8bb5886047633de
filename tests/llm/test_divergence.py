"""Source divergence against a brute-force version, and the pointer sort by itself."""

import random
import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pytest

from twinscript.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute_force(rows, least, top):
    docs, n = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        n[lang, source].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: n[lang, s][t] for t in kept})

        def rates(counts):
            size = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // size for t in kept}

        p, q = {s: rates(n[lang, s]) for s in sources}, rates(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out, key=repr)


def drawn(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abCé", k=r.randint(1, 18))) for _ in range(120)] + ["x" * 40, "x" * 41, "ABCDEFG", "abcdefgh", "日本語", "Ünï"]
    rows = []
    for i in range(400):
        source = r.choice(["hot"] * 4 + ["a", "b", "c", None])
        picked = r.choices(words, weights=[1 + (hash((w, source)) % 7) for w in words], k=r.randint(0, 25))
        rows.append((i, r.choice([" ", "\n", "-", "1"]).join(picked), r.choice(["en", "en", "de", None]), source))
    rows += [(1, None, "en", "none"), (2, "", "xx", "only"), (3, "rare words", "yy", "p"), (4, "other", "yy", "q"), rows[0], rows[0], (None, "abC abC", "en", "hot")]
    return rows


@pytest.mark.parametrize("cells,at_once", [(2_000_000, 1_000), (40, 2)])
def test_equals_brute_force_in_one_slice_and_in_many(spark, frame, collect, monkeypatch, cells, at_once):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "SOURCES_AT_ONCE", at_once)
    source = divergence._slice_distances
    # Workers import the module anew, so the small bounds travel with a copy of the function.
    monkeypatch.setattr(divergence, "_slice_distances", _with(source, CELLS=cells, SOURCES_AT_ONCE=at_once))
    rows = drawn(cells)
    got = collect(divergence.source_divergence(frame(rows), least_documents=10, top=7), *COLUMNS)
    assert got == brute_force(rows, 10, 7)
    assert {g[0] for g in got} == {"en", "de", "", "yy"}


def _with(function, **values):
    """``function`` with other values for its module's constants."""
    import types

    copy = types.FunctionType(function.__code__, {**function.__globals__, **values, "__name__": "__main__"}, function.__name__)
    copy.__module__ = "__main__"
    return copy


def test_pointer_sort(spark):
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("ab", k=r.randint(1, 30))) for _ in range(r.randint(0, 60))) for _ in range(50)] + ["", "ab", "ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, stops = divergence.token_pointers(data, cuts)
    got = divergence.strings_at(data, starts, stops).to_pylist()
    assert got == list(chain.from_iterable(TERM.findall(t) for t in texts))
    for slices in (np.zeros(len(starts), np.int64), np.searchsorted(cuts, starts, side="right")):
        run, heads = divergence.equal_runs(data, starts, stops, slices)
        pairs = list(zip(slices.tolist(), got))
        assert len(heads) == len(set(pairs)) == run.max() + 1
        assert [pairs[h] for h in heads[run].tolist()] == pairs


def test_a_very_long_text_is_one_document(spark, monkeypatch):
    text = "Alpha beta " * 300 + "gamma" * 100
    cut = _blocks_of(text, 64)
    assert cut == [("alpha", 300, 1), ("beta", 300, 1), ("gamma" * 100, 1, 1)]


def _blocks_of(text, block):
    import pyarrow as pa

    class Docs:
        """Catches the function that runs on the workers, to call it here with small blocks."""

        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            self.function = _with_closure(function, BLOCK_BYTES=block)
            return self

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self.function

    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["s"]), pa.array([text])], ["lang", "source", "text"])
    out = list(divergence.source_counts(Docs())(iter([batch])))
    return sorted((r["term"], r["n"], r["docs"]) for b in out for r in b.to_pylist() if r["term"])


def _with_closure(function, **values):
    import types

    return types.FunctionType(function.__code__, {**function.__globals__, **values}, function.__name__, None, function.__closure__)


def test_rates_do_not_overflow(spark, values):
    pairs = [(5, 5), (10**13, 3 * 10**13), (9 * 10**15, 9 * 10**15), (7, 9 * 10**15)]
    got = values(pairs, "n long, w long", lambda c: divergence.rate(c("n"), c("w")))
    assert got == [1 + 10**9 * n // w for n, w in pairs]
    n, w = (np.array(x, np.int64) for x in zip(*pairs))
    assert divergence._rates(n, w).tolist() == got


def test_empty_table(spark, frame):
    assert divergence.source_divergence(frame([])).count() == 0
