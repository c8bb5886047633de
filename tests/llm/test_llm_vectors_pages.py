"""Exact search, extraction, the registered queries and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinscript.llm import extraction, html_blocks, labelled_pages, topk
from twinscript.llm.catalog import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-2, 3, 8).astype(float).tolist(), "x", "y") for i in range(300)]
    rows += [(300, None, "x", "y"), (400, [1.0] * 7 + [None], "x", "y"), (500, [float("nan")] * 8, "x", "y"), (None, [1.0] * 8, "x", "y"), (600, [1.5], "x", "y"), (700, [3e38] * 8, "x", "y"), (700, [3e38] * 8, "x", "y")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _v string, score string")
    got = topk.exact_top_k(vectors, F.col("vec_id") % 100 == 0, 10, 1024.0, candidates_per_cell=50, queries_per_cell=2).collect()
    known = {i: [int(np.floor(1024 * x)) for x in v] + [0] * (8 - len(v)) for i, v, *_ in rows if i is not None and v and None not in v and not np.isnan(v).any()}
    expected = []
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    for q in (i for i in known if i % 100 == 0):
        scored = sorted(((-clamp(sum(a * b for a, b in zip(known[q], v))), i) for i, v in known.items() for _ in range(2 if i == 700 else 1) if i != q))[:10]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert topk.exact_top_k(vectors.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_blocks_of_broken_markup():
    html = "<div>a<p>b <b>c<br>d<p>e&amp;&copy;&#228;<ul><li>x<li>y</ul><script>var t='</p>'</script><td>z"
    assert [b.text for b in html_blocks.blocks_of(html)] == ["a", "b c d", "e&©ä", "x", "y", "z"]
    assert html_blocks.blocks_of("") == [] and html_blocks.blocks_of("<p>  </p>") == []


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<html><head><title>t</title><p>article<p>more", ["article", "more"]),
        ("<head><meta charset=x><title>t</title><script>a()</script>bare <b>text</b><p>more", ["bare text", "more"]),
        ("<head><title>t</title><noscript><link href=x><style>b{}</style></noscript><meta name=y><b>a</b>", ["a"]),
        ("<head><title>t</title><noscript><p>off</p></noscript><p>more", ["off", "more"]),
        ("<head><template><p>no</p></template><style>p{}</style></head><p>yes<body><p>more", ["yes", "more"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<p><svg/>a<svg><text>b</text></svg>", ["so x=2 holds", "ab"]),
        ("<noscript><p>one</p></noscript><object>two</object><audio>three</audio><video>four</video>", ["one", "twothreefour"]),
    ],
)
def test_blocks_without_head_end_or_body(html, texts):
    assert [b.text for b in html_blocks.blocks_of(html)] == texts


def test_field_on_held_out_layouts():
    field = extraction.default_field()
    right = total = 0
    for html, text in labelled_pages.drawn_pages(120, seed=77):
        blocks, gold = extraction.aligned(html, text)
        labels = field.labels(blocks)
        right += sum(a == b for a, b in zip(gold, labels))
        total += len(gold)
    assert right / total > 0.98


def test_viterbi_finds_the_best_path():
    field = extraction.default_field()
    blocks = html_blocks.blocks_of(labelled_pages.drawn_pages(3, seed=9)[2][0])[:9]
    scores = [np.sum([field.weights[f] for f in names if f in field.weights], axis=0) for names in html_blocks.features(blocks)]

    def value(path):
        return field.start[path[0]] + sum(s[k] for s, k in zip(scores, path)) + sum(field.step[a][b] for a, b in zip(path, path[1:]))

    paths = [[n >> i & 1 for i in range(len(blocks))] for n in range(2 ** len(blocks))]
    assert value(field.labels(blocks)) == pytest.approx(max(map(value, paths)))


def test_extract_odd_pages(spark):
    page = "<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title</h1><p>Some text, here.</p></article><footer>&copy; me</footer>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", page, "x"), (None, "u", page, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extraction.extract_main_text(pages).collect()), key=repr)
    full = (None, "u", "Title\nSome text, here.", 22)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), full, full], key=repr)
    assert extraction.extract_main_text(pages.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    fn, sql = QUERIES[name]
    df = fn(spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    result = con.execute(sql)
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_DIR)
        assert kept.columns == docs.columns
