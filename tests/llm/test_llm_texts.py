"""Operators over texts against brute force, odd rows included."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from twinscript.llm import licenses, mixing, packing, quality, repeats, simhash, substrings, suffixes, tables, toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def removed(items, window):
    counts = Counter(tuple(x[i : i + window]) for x in items for i in range(len(x) - window + 1))
    out = []
    for x in items:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - window + 1):
            if counts[tuple(x[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


def test_cover_holds_every_difference():
    cover = substrings.COVER
    assert {(a - b) % substrings.PERIOD for a in cover for b in cover} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("window", [35, 21])
def test_substring_dedup(frame, odd_rows, collect, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t, *_ in odd_rows]
    expected = [
        (row[0], len(w), int(g.sum()), hashlib.sha256(b" ".join(x for x, out in zip(w, g) if not out)).hexdigest())
        for row, w, g in zip(odd_rows, words, removed(words, window))
    ]
    got = collect(substrings.substring_dedup(frame(odd_rows), window), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(expected, key=repr)
    assert any(0 < x[2] < x[1] for x in got)


def test_without_repeats_keeps_columns(frame, odd_rows):
    docs = frame(odd_rows)
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 4 not in texts and 5 not in texts  # copies go as a whole, nothing is left of them
    assert len(texts[8].split()) == 100 and 2 not in texts


@pytest.mark.parametrize("sizes", [{}, {"shard_nodes": 2, "split_nodes": 1}])
def test_suffix_array_dedup(frame, odd_rows, collect, sizes):
    rows = [*odd_rows, (90, "a" * 1200, "en", "a"), (91, "ab" * 500, "en", "a"), (92, "é" * 450, "en", "a")]
    data = [(t or "").encode() for _, t, *_ in rows]
    expected = []
    for row, raw, gone in zip(rows, data, removed(data, 400)):
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, out in zip(raw, gone) if not out)
        expected.append((row[0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = collect(suffixes.suffix_array_dedup(frame(rows), **sizes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(expected, key=repr)


class _Unlaid:
    """In the place of a DataFrame: hands ``decided`` its own worker function back."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, function, _):
        return function


@pytest.mark.parametrize("keys", [[1] * 3000, list(range(300)), [1] * 7 + [2] * 2500 + [3] * 10 + [4] * 483])
def test_nodes_of_a_minimizer_meet_over_batches(monkeypatch, keys):
    r = np.random.default_rng(2)
    h, node = np.array(keys), r.integers(0, len(keys) // 2, len(keys))
    order = np.lexsort((node, h))
    whole = [h[order], node[order], np.arange(len(h)), (r.integers(0, 400, len(h)) << 9 | 5) << 2 | r.integers(0, 3, len(h))]
    names = ["h", "node", "_id", "x"]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in whole], names)
    batches = [b for a in range(0, len(h), 10) for b in (rows.slice(a, 10), rows.slice(a, 0))]
    joined, concatenate = [], np.concatenate
    monkeypatch.setattr(suffixes, "_decide", lambda *c: pa.RecordBatch.from_arrays([pa.array(x) for x in c[:4]], names))
    monkeypatch.setattr(np, "concatenate", lambda parts, *a, **b: joined.append(sum(map(len, parts))) or concatenate(parts, *a, **b))
    out = list(suffixes.decided(_Unlaid(), 1)(iter(batches)))
    monkeypatch.undo()
    for i, column in enumerate(whole):
        assert concatenate([b.column(i).to_numpy() for b in out]).tolist() == column.tolist()
    found = [set(b.column(0).to_pylist()) for b in out]
    assert all(not a & b for a, b in zip(found, found[1:]))  # no minimizer is cut in two
    assert sum(joined) <= 2 * sum(map(len, whole))  # and none is put together again with every batch


def test_suffix_array_sorts_to_its_depth():
    r = np.random.default_rng(1)
    text = np.concatenate([r.integers(97, 99, 600).astype(np.uint8)] * 2 + [np.zeros(40, np.uint8)])
    order, rank = suffixes.suffix_array(text, 40)
    keys = [text[i : i + 40].tobytes() for i in order]
    assert keys == sorted(keys)
    assert all((keys[i] == keys[i + 1]) == (rank[order[i]] == rank[order[i + 1]]) for i in range(len(keys) - 1))
    shared = suffixes.common_prefixes(text, order, 100)
    for i in range(1, len(order)):
        a, b = text[order[i - 1] :], text[order[i] :]
        n = min(len(a), len(b), 100)
        differ = np.flatnonzero(a[:n] != b[:n])
        true = differ[0] if len(differ) else n
        assert shared[i] == true if true < 50 else shared[i] >= 50


def test_near_duplicates(frame, odd_rows, collect):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t, *_ in odd_rows]
    group = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, row in zip(group, odd_rows):
        least[g] = min((x for x in (least.get(g), row[0]) if x is not None), default=None)
    expected = [(row[0], f"{p:016x}", least[g]) for row, p, g in zip(odd_rows, prints, group)]
    assert collect(simhash.near_duplicates(frame(odd_rows)), "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)


def test_links_lose_none_in_a_crowded_key():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 1).astype(np.uint64)[0]
    flips = np.uint64(1) << r.integers(0, 64, (200, 3)).astype(np.uint64)
    fps = (base ^ np.bitwise_xor.reduce(flips, axis=1))[:, None]
    table = np.stack([np.bitwise_count(fps ^ p).sum(1, dtype=np.int16) for p in simhash.pivots(1)], 1)
    forest = simhash.Forest()
    for a, b in simhash._links_of_groups(np.zeros(200, np.int64), fps, table, 3):
        forest.joins(a, b)
    for i in range(200):
        for j in range(i):
            if int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 3:
                assert forest.top(i) == forest.top(j)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (60, 100), (-5, 60), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: -5 for i in (50, 60, 100, -5)}}


def test_keep_one(frame, odd_rows):
    docs = frame(odd_rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 4 in ids and 5 not in ids and 6 not in ids  # copy and near copy
    assert 1 in ids and 2 not in ids and 3 not in ids  # empty texts are copies
    assert ids.count(12) == 1 and None in ids and 8 in ids and ids.count(11) == 2
    assert {20 + i for i in range(40)} <= set(ids)


def test_keep_one_decides_by_exact_similarity(frame):
    r = np.random.default_rng(11)
    texts = []
    for n in range(240):
        words = [f"w{x}" for x in r.integers(0, 50_000, 229)]
        # Of 225 shingles each changed word far from others costs five: 0.751, 0.801, 0.854 by their number.
        other = list(words)
        for k in range((6, 5, 3, 7)[n % 4]):
            other[10 + 30 * k] = "x"
        texts += [" ".join(words), " ".join(other)]
    # A chain: its ends are alike by less than 0.8 and still go together; repeats of a phrase count once.
    chain = [f"c{x}" for x in range(229)]
    for at in (0, 60, 120, 180):
        chain = [*chain[:at], *[f"d{at}x{i}" for i in range(14)], *chain[at + 14 :]]
        texts.append(" ".join(chain))
    texts += ["a b c d e f g h " * 10, "a b c d e f g h " * 90]
    words = [t.lower().split() for t in texts]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    group = list(range(len(texts)))
    for _ in range(5):
        for i, a in enumerate(shingles):
            for j in range(i):
                if (n := len(a & shingles[j])) and n / len(a | shingles[j]) >= 0.8:
                    group[i] = group[j] = min(group[i], group[j])
    expected = {i for i, g in enumerate(group) if i == g}
    assert 250 < len(expected) < 400
    kept = simhash.keep_one(frame([(i, t, "en", "a") for i, t in enumerate(texts)]))
    assert sorted(row["doc_id"] for row in kept.collect()) == sorted(expected)


def test_candidates_of_a_key_leave_as_a_forest():
    r = np.random.default_rng(5)
    fps = r.integers(0, 2**63, (1, 4)).astype(np.uint64) ^ (np.uint64(1) << r.integers(0, 63, (60, 4)).astype(np.uint64))
    keys, sizes = np.zeros(60, np.int64), np.full(60, 100)
    table = np.zeros((60, 0), np.int16)
    assert len(simhash._nearest_proposals(keys, fps, table, sizes, 70)) == 59
    sizes[:30] = 79
    assert len(simhash._nearest_proposals(keys, fps, table, sizes, 70)) == 58


def exact_groups(sets):
    """The smallest member of every set's group, by comparing all pairs."""
    group = list(range(len(sets)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                group[y] = x
    return [top(x) for x in range(len(sets))]


def test_sets_of_a_group_are_decided_exactly():
    r = np.random.default_rng(9)
    for trial in range(30):
        base = r.integers(0, 400, 60)
        sets = [set(np.concatenate([base[: r.integers(1, 60)], r.integers(0, 400, r.integers(0, 12))]).tolist()) for _ in range(40)]
        sets += [set(), {1, 2, 3, 4}, {1, 2, 3, 4, 5}]
        sizes = np.array([len(x) for x in sets])
        links = simhash.linked_sets(sizes, np.array([x for y in sets for x in sorted(y)]), np.arange(len(sets)))
        assert all(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i, j in links)
        forest = simhash.Forest()
        assert all(forest.joins(i, j) for i, j in links)
        assert [forest.top(x) for x in range(len(sets))] == exact_groups(sets)


def variants(r, n, changed, words=300):
    """Texts that differ from one and the same text in ``changed`` of its words."""
    base = [f"w{x}" for x in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in r.choice(np.arange(5, words - 5, 7), changed, replace=False):
            own[k] = f"v{i}x{k}"
        out.append(" ".join(own))
    return out


def test_crowded_keys_and_clusters_are_decided_in_blocks(spark, frame):
    r = np.random.default_rng(3)
    # Unlike each other, a third of all; alike to their first; chains; and single texts.
    texts = variants(r, 60, 5) + [t.replace("w", "u") for t in variants(r, 40, 1)] + [t.replace("w", "t") for t in variants(r, 40, 3)]
    texts += [" ".join(f"s{x}" for x in r.integers(0, 9_000, 80)) for _ in range(40)]
    words = [t.split() for t in texts]
    group = exact_groups([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words])
    expected = sorted({g for g in group})
    assert 90 < len(expected) < 160
    docs = frame([(i, t, "en", "a") for i, t in enumerate(texts)])
    for bounds in ({}, {"key_nodes": 8, "block": 2_000}):
        assert sorted(row["doc_id"] for row in simhash.keep_one(docs, **bounds).collect()) == expected


def test_mutually_unlike_variants_make_rows_in_proportion_to_nodes(spark, frame, monkeypatch):
    rows = {}
    for n in (200, 400):
        staged = {}

        def counting(df, label="stage", **options):
            out = tables.staged(df, label, **options)
            staged[label] = staged.get(label, 0) + out.count()
            return out

        monkeypatch.setattr(simhash, "staged", counting)
        texts = variants(np.random.default_rng(n), n, 5)
        words = [t.split() for t in texts]
        groups = exact_groups([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words])
        assert len(set(groups)) > 0.9 * n  # a few happen to change nearly the same words
        assert simhash.keep_one(frame([(i, t, "en", "a") for i, t in enumerate(texts)])).count() == len(set(groups))
        rows[n] = staged
        assert staged["near-proposals"] <= simhash.BANDS * n and staged["near-sets"] == n and staged["near-links"] < n / 10
    assert all(rows[400][label] <= 3 * rows[200][label] for label in rows[200] if label != "near-links")


def test_packing_round_trip(frame, odd_rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = [*odd_rows, (70, "İstanbul don't 's ΣΑΣ, x<|endoftext|>y a..b, c!?", "en", "a")]
    packed = packing.pack_documents(frame(rows), VOCABULARY, size=128, shard_documents=20, with_ids=True)
    got = sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect())
    expected = []
    for i, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(i or 0, n, s, len(ids[s : s + 128]), zlib.crc32(ids[s : s + 128].tobytes())) for n, s in enumerate(range(0, len(ids), 128))]
    assert got == sorted(expected)
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert all(len(x) <= 128 for x in made.values())
    for r in packed.collect():
        part = made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert sum(map(len, made.values())) == sum(x[3] for x in expected)  # gapless


def test_best_two_fit_fills_bins():
    r = np.random.default_rng(2)
    lengths = r.integers(1, 1500, 4000)
    bins, offsets = packing.best_two_fit(lengths, 2048)
    used = np.bincount(bins, lengths)
    assert used.max() <= 2048 and bins.max() + 1 <= -(-lengths.sum() // 2048) * 1.01
    # 6 + 3 leave a gap that 2 + 2 close in the place of 3.
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(np.bincount(bins, [6, 3, 2, 2]).tolist()) == [3, 10]
    assert len(packing.best_two_fit(np.zeros(0, np.int64), 10)[0]) == 0


def test_quality_figures(frame, odd_rows, collect):
    expected = []
    for i, text, *_ in odd_rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        covered = {k for j, g in enumerate(grams) if g in twice for k in range(j, j + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed))
    got = quality.quality_rules(frame(odd_rows))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert collect(got, *columns) == sorted(expected, key=repr)
    assert not got.filter("base_failed AND kept").count()


def test_quality_verdicts(frame):
    good = [(i, " ".join(["the river and a house of stone in it"] + [f"word{'abcdefghij'[j % 10]}{'klmnopq'[(i * j) % 7]}{'rstuv'[(j * j + i) % 5]}x{'abcdefg'[(j + i) % 7]}" for j in range(90)]), "en", "a") for i in range(30)]
    bad = [(100, " ".join(f"%%{w}$$#" for w in good[0][1].split()), "en", "a"), (101, good[1][1].upper(), "en", "a")]
    verdicts = {r["doc_id"]: r["kept"] for r in quality.quality_rules(frame(good + bad)).collect()}
    assert all(verdicts[i] for i in range(30)) and not verdicts[100] and not verdicts[101]
    docs = frame(good + bad)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(30))


def test_quality_holds_each_language_against_its_own(frame):
    r = np.random.default_rng(8)
    italian = "il gatto e la volpe che non si trova nella casa di un vecchio amico con molte belle parole".split()
    japanese = ["これは", "日本語の", "文章です。", "とても", "きれいな", "花が", "咲いて", "いました。", "そして", "雨も"]
    texts = {lang: [" ".join(f"{w}{k}" if k < 3 else w for w, k in zip(r.choice(words, 90), r.integers(0, 9, 90))) for _ in range(n)] for lang, words, n in (("IT", italian, 100), ("ja", japanese, 2))}
    rows = [(i, t, lang, "a") for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    rows += [(200, texts["ja"][0], "it", "a")]
    docs = frame(rows)
    verdicts = {row["doc_id"]: row["kept"] for row in quality.quality_rules(docs).collect()}
    assert [i for i, kept in verdicts.items() if not kept] == [200]
    assert sorted(row["doc_id"] for row in quality.keep_good(docs).collect()) == list(range(102))
    listed = {row["_lang"]: row["_listed"] for row in quality.common_words(docs).collect()}
    assert set(listed) == {"it", "ja"} and all(len(x) == quality.WORD_SLOTS for x in listed.values())
    assert set(listed["ja"]) <= {w for t in texts["ja"] for w in t.split()}


def test_license_scan(frame, collect):
    notice = licenses.NOTICES[0][1]
    cut = notice.split(" ")
    cut[20:20] = ["some", "inserted"]
    rows = [
        (1, "Released under the MIT License. MIT-License mit license", "en", "a"),
        (2, "general public license, Apache License", "en", "a"),
        (3, " ".join(cut), "en", "a"),
        (4, "mit licenses, general license public", "en", "a"),
        (5, None, "en", "a"),
        (None, "mit license", "en", "a"),
        (1, "Released under the MIT License. MIT-License mit license", "en", "a"),
    ]
    got = collect(licenses.license_scan(frame(rows)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    first = (1, 9, 3, 3, 7, "mit", "mit")
    expected = [first, first, (2, 5, 2, 0, 3, "apache,gpl", "apache,gpl"), (3, len(cut), 0, None, None, "", "mit"), (4, 5, 0, None, None, "", ""), (5, 0, 0, None, None, "", ""), (None, 1, 0, None, None, "", "")]
    assert got == sorted(expected, key=repr)


def test_mixing_meets_quotas(frame):
    rows = [(i, "w " * (1 + i % 50), "en", "big" if i % 10 < 8 else None if i % 10 == 8 else "small") for i in range(3000)]
    mix = mixing.Mix(entropy=0.97, max_repeats=3.0, block_documents=100)
    docs = frame(rows)
    plan = mixing.mixing_plan(mixing._measured(docs, mix.seed), mix).toPandas()
    share = plan["weight"]
    assert -(share * np.log(share)).sum() / np.log(3) == pytest.approx(0.97, abs=1e-3) or (plan["quota"] / plan["tokens"]).max() == pytest.approx(3.0, abs=1e-3)
    got = mixing.mix_sources(docs, mix).toPandas()
    taken = got.groupby(got["source"].fillna("none"))["n_tokens"].sum()
    for _, p in plan.iterrows():
        name = p["_source"][1:] if p["_source"] != "null" else "none"
        assert p["quota"] - 50 < taken[name] <= p["quota"]
    assert not got.duplicated(["doc_id", "epoch"]).any()
    assert mixing.mixed(docs, mix).count() == len(got)


def test_toxicity_learns(frame, spark):
    r = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{x}" for x in r.integers(0, 300, 40)]
        toxic = i % 10 == 0
        if toxic:
            words[5:5] = [["nasty", "foul"][i % 20 // 10]]
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(toxic)))
    rows += [(None, None, None, None), (5000, "NASTY!", "en", "a")]
    out = toxicity.toxicity(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(x["predicted"], x["doc_id"] % 10 == 0) for x in out if x["held_out"] and x["doc_id"] < 1500]
    assert len(held) > 400 and all(p == int(t) for p, t in held)
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in out if x["doc_id"] is not None)
    assert next(x for x in out if x["doc_id"] == 5000)["predicted"] == 1
    assert next(x for x in out if x["doc_id"] is None)["predicted"] == 0


def test_non_negative_risk_keeps_unlabelled_positives_out():
    r = np.random.default_rng(8)
    positive = np.arange(400) < 100
    marked = positive | (np.arange(400) >= 370)  # a tenth of the unlabelled are positive too
    noise = r.random(400) < 0.5
    rows = np.concatenate([np.flatnonzero(marked), np.flatnonzero(noise)])
    columns = np.concatenate([np.zeros(marked.sum(), int), np.ones(noise.sum(), int)])
    weights, bias = toxicity.non_negative_fit(rows, columns, positive, 0.1, 2, toxicity.Fit())
    assert weights[0] + bias > 1 and bias < -1 and abs(weights[1]) < weights[0] / 3


@pytest.mark.parametrize(
    "run",
    [
        lambda d: packing.pack_documents(d, VOCABULARY),
        substrings.substring_dedup,
        licenses.license_scan,
        quality.quality_rules,
        suffixes.suffix_array_dedup,
        simhash.near_duplicates,
        mixing.mix_sources,
        simhash.keep_one,
        quality.keep_good,
        substrings.without_repeats,
        mixing.mixed,
    ],
)
def test_empty_table(frame, run):
    assert run(frame([])).collect() == []


def test_empty_labels(frame, spark, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(frame(odd_rows), none).collect()} == {0}
    assert toxicity.toxicity(frame([]), none).collect() == []


def test_mixing_equals_a_walk_over_the_documents(frame, collect):
    """An own bisection, quotas, and what a walk over every source's blocks takes."""
    import math

    r = np.random.default_rng(12)
    rows = [(i, "w " * int(r.integers(1, 60)), "en", ["big", "big", "big", "big", "mid", None, "small"][i % 7] if i % 50 else "tiny") for i in range(2500)]
    docs = frame(rows)
    for mix in (mixing.Mix(block_documents=64), mixing.Mix(gap=0.9, max_repeats=2.0, budget=0.5, block_documents=64)):
        tokens = Counter()
        for _, t, _, s in rows:
            tokens[s] += len(t.split())
        total = sum(tokens.values())

        def weights(a):
            raw = {s: (n / total) ** a for s, n in tokens.items()}
            return {s: x / sum(raw.values()) for s, x in raw.items()}

        entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
        repeats = lambda a: max(w * mix.budget * total / tokens[s] for s, w in weights(a).items())
        target = entropy(1.0) + mix.gap * (math.log(len(tokens)) - entropy(1.0))

        def bisect(low_holds):
            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if low_holds(mid) else (lo, mid)
            return lo

        even = bisect(lambda a: entropy(a) >= target)
        scarce = 0.0 if repeats(0.0) <= mix.max_repeats else bisect(lambda a: repeats(a) > mix.max_repeats)
        w = weights(max(even, scarce))
        assert max(even, scarce) < 0.95  # something is mixed
        got = mixing.mix_sources(docs, mix).toPandas()
        copies = Counter(zip(got["doc_id"], [None if x != x else x for x in got["source"].where(got["source"].notna(), None)]))
        block = {d: b for d, b in zip(got["doc_id"], got["block"])}
        for s, n in tokens.items():
            quota = w[s] * mix.budget * total
            epochs = math.floor(quota / n + 1e-9)
            own = [(i, len(t.split())) for i, t, _, source in rows if source == s]
            taken = sum(copies[i, s] * k for i, k in own)
            assert quota - 61 <= taken <= quota + 1
            assert all(copies[i, s] in (epochs, epochs + 1) for i, _ in own)
            # Of the last epoch whole blocks are in or out, but for one that is cut.
            state = {}
            for i, _ in own:
                if i in block:
                    state.setdefault(block[i], set()).add(copies[i, s] > epochs)
            assert sum(len(x) == 2 for x in state.values()) <= 1


def test_few_confirmed_texts_teach(frame, spark):
    r = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(700):
        words = [f"w{x}" for x in r.integers(0, 200, 30)]
        if i % 70 == 3:
            words[4:4] = ["vile", "foul"]
        rows.append((i, " ".join(words), "en", "a"))
    outside = [i for i in range(700) if i % 70 == 3 and zlib.crc32(str(i).encode()) % 3 != 1]
    for n in (4, 6):
        labels = [(i, 1, int(i in outside[:n])) for i in range(700) if i % 70 != 3 or i in outside[:n]]
        out = toxicity.toxicity(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert all(x["predicted"] == int(x["doc_id"] % 70 == 3) for x in out)


def test_repeats_of_one_line_are_no_license(frame):
    names = {label: text for label, text in licenses.NOTICES}
    notice = names["apache"]
    rows = [
        (1, "http www apache org " * 16, "en", "a"),
        (2, "x " * 50 + notice, "en", "a"),
        (3, " ".join(w for i, w in enumerate(notice.split()) if i % 12 != 5), "en", "a"),
        (4, (" ".join(notice.split()[:6]) + " filler words between them all ") * 40, "en", "a"),
        (5, "MIT LICENSE K", "en", "a"),
        (6, "mİt license", "en", "a"),
    ]
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(rows)).collect()}
    assert got[1]["labels"] == "" and got[1]["score"] < 0.3 and got[4]["labels"] == ""
    assert "apache" in got[2]["labels"] and got[2]["score"] == 1.0
    assert got[5]["base_labels"] == "mit" and got[6]["n_base"] == 0


def test_keep_good_measures_texts_once(frame, odd_rows, monkeypatch):
    plans = []
    for name in ("staged", "staged_texts"):
        real = getattr(quality, name)
        monkeypatch.setattr(quality, name, lambda df, *a, real=real, **b: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a, **b))
    kept = quality.keep_good(frame([row for row in odd_rows if row[2] in quality.COMMON_WORDS]))
    assert sum("xxhash64(_w" in p for p in plans) == 1
    # The references read figures only, not the rows beside them; nor does the verdict measure again.
    assert len(plans) == 3 and not any("_row" in p for p in plans[1:])
    assert "xxhash64(_w" not in kept._jdf.queryExecution().executedPlan().toString()


def test_rolling_shingles_are_those_of_the_texts(odd_rows):
    texts = [t or "" for _, t, _, _ in odd_rows] + ["A b\u00c9 c D e f", "a b\u00c9 C d e\x0bF", "a b\u00e9 c d e f", "\u00a0 a", "one\x85two"]
    hashes, sizes = simhash._shingle_hashes(texts, 5)
    rolling, same_sizes = simhash._rolling_hashes(texts, 5, repeats.Powers())
    assert sizes.tolist() == same_sizes.tolist()
    # Equal shingles have equal hashes, others differ.
    first = lambda h: np.unique(h, return_index=True)[1][np.unique(h, return_inverse=True)[1]]
    assert first(hashes).tolist() == first(rolling).tolist()


@pytest.mark.parametrize("edges, rounds", [([], 0), ([(5, 1), (1, 9), (3, 2)], 0), ([(2, 1), (3, 2)], 1)])
def test_components_stop_when_stars_are_left(spark, monkeypatch, edges, rounds):
    calls = []
    monkeypatch.setattr(simhash, "staged", lambda df, *a, real=simhash.staged: calls.append(1) or real(df, *a))
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {0: {}, 3: {1: 1, 5: 1, 9: 1, 2: 2, 3: 2}, 2: {1: 1, 2: 1, 3: 1}}[len(edges)]
    assert len(calls) == 2 + 2 * rounds


def test_only_texts_with_repeats_are_cut_again(frame, odd_rows):
    docs = frame(odd_rows)
    results = {r["_key"]: r for r in substrings.deduplicated_texts(docs).collect()}
    fewer = substrings.deduplicated_texts(docs, repeats_only=True).collect()
    assert all(r == results[r["_key"]] for r in fewer) and len(fewer) < len(results) / 2
    assert {r["_key"] for r in fewer} >= {k for k, r in results.items() if r["n_removed"]}
    plan = substrings.without_repeats(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInArrow remove.*\n\W+Filter.*copies.* > 1|MapInArrow remove.*\n\W+Project.*\n\W+Filter.*copies.* > 1", plan)
