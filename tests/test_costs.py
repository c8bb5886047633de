import math

import pytest

from twinscript import rules, schemas
from twinscript.functions import cost
from twinscript.operators import costs


def test_request_count(values):
    rows = [(0, 0), (1, 1), (16, 16), (17, 16), (100, 16), (100, -5)]
    assert values(rows, "n long, b int", lambda c: cost.request_count(c("n"), c("b"))) == [1, 1, 1, 2, 7, 1]


def test_output_tokens_round_to_even(values):
    rows = [(100, 1.5, 5.0), (101, 1.5, 4.0), (0, 2.0, 4.0), (1, 2.5, 1.0)]
    got = values(rows, "n long, e double, a double", lambda c: cost.output_tokens(c("n"), c("e"), c("a")))
    assert got == [30, 38, 0, 2]


def test_split_cached_input(values):
    rows = [(10000, 2000, 3, False), (10000, 2000, 1, False), (10000, 2000, 3, True), (10000, 1024, 3, False)]
    got = values(
        rows, "t long, p long, n long, x boolean", lambda c: cost.split_cached_input(c("t"), c("p"), c("n"), c("x"))
    )
    assert [tuple(r) for r in got] == [(6000, 1952), (10000, 0), (10000, 0), (10000, 0)]


def test_split_cached_read_write(values):
    rows = [(10000, 2000, 3, True), (10000, 2000, 3, False), (500, 0, 3, True)]
    got = values(
        rows, "t long, p long, n long, w boolean",
        lambda c: cost.split_cached_read_write(c("t"), c("p"), c("n"), False, c("w")),
    )
    assert [tuple(r) for r in got] == [(4000, 1952, 976), (6000, 1952, 0), (500, 0, 0)]


def _cost(spark, model, parts, out):
    from pyspark.sql import functions as F

    price = costs.default_pricing(spark).filter(F.col("model") == model)
    names = ["uncached_in", "cached_in", "cached_read", "cached_write"]
    struct = F.struct(*[F.lit(parts.get(n, 0)).alias(n) for n in names])
    rates = F.struct(*[F.col(r) for r in costs.RATES])
    return price.select(cost.estimate_cost(struct, F.lit(out), rates)).first()[0]


def test_estimate_cost(spark):
    assert math.isclose(_cost(spark, "openai:gpt-5", {"uncached_in": 6000, "cached_in": 1952}, 2500), 0.032744)
    parts = {"uncached_in": 4000, "cached_read": 1952, "cached_write": 976}
    assert math.isclose(_cost(spark, "anthropic:claude-sonnet-4", parts, 0), 0.0162456)
    assert _cost(spark, "openai:gpt-4.1", {"uncached_in": 1000}, 1000) is None


def test_overlay_replaces_whole_rows(spark):
    base = costs.default_pricing(spark)
    new = spark.createDataFrame([("openai:gpt-5", "openai", 9.0, None, None, None, None, "t")], schemas.PRICING)
    got = {r["model"]: r for r in costs.overlay_pricing(base, new).collect()}
    assert len(got) == len(rules.MODEL_PRICES)
    assert got["openai:gpt-5"]["in"] == 9.0 and got["openai:gpt-5"]["out"] is None


def test_report_and_unknown_models(spark):
    blocks = spark.createDataFrame([("d", "abcこんにちはde"), ("d", "ノート"), ("e", "x")], "deck_id string, text string")
    pricing = costs.default_pricing(spark)
    got = {r["deck_id"]: r for r in costs.deck_cost_report(blocks, pricing).collect()}
    assert (got["d"]["tokens"], got["d"]["script_chars"], got["d"]["n_requests"]) == (13, 8, 1)
    assert math.isclose(got["d"]["total_cost"], 13e-6 * 1.25 + 3e-6 * 10 + 13e-6 * 0.25)
    with pytest.raises(ValueError, match="acme:none"):
        costs.deck_cost_report(blocks, pricing, reviewer="acme:none")
    asked = spark.createDataFrame([("acme:none",), ("openai:gpt-5",)], "model string")
    assert [r[0] for r in costs.unknown_models(asked, pricing).collect()] == ["acme:none"]


def test_providers_without_discount_bill_all_input(spark):
    blocks = spark.createDataFrame([("d", "x" * 1000)], "deck_id string, text string")
    work = costs.deck_workload(costs.token_totals(blocks), prefix_tokens=2000)
    row = costs.price_alternatives(work, costs.default_pricing(spark), ["google:gemini-2.0-flash"]).first()
    assert row["uncached_in"] == 1000 and math.isclose(row["cost"], 1000 / 1e6 * 0.10)


def test_tokenizer_hook(spark):
    blocks = spark.createDataFrame([("d", "one two"), ("d", "three")], "deck_id string, text string")
    row = costs.token_totals(blocks, costs.tokenizer(str.split)).first()
    assert row["tokens"] == 3


def test_each_model_counts_with_its_own_encoder(spark):
    blocks = spark.createDataFrame([("d", "one two three")], "deck_id string, text string")
    rates = spark.createDataFrame(
        [("a:p", "a", 1e6, None, None, None, None, "words"), ("a:r", "a", 1e6, None, None, None, None, "unknown")],
        schemas.PRICING,
    )
    encoders = {"words": str.split, "o200k_base": list}
    row = costs.deck_cost_report(blocks, rates, "a:p", "a:r", encoders=encoders).first()
    assert (row["producer_cost"], row["reviewer_cost"], row["tokens"]) == (3.0, 13.0, 3)


def test_prefix_in_each_models_own_tokens(spark):
    blocks = spark.createDataFrame([("d", "w " * 9000)] + [("d", "x")] * 39, "deck_id string, text string")
    rates = spark.createDataFrame(
        [("openai:chars", "openai", 1.0, 0.1, 0.0, None, None, "o200k_base"), ("openai:words", "openai", 1.0, 0.1, 0.0, None, None, "words")],
        schemas.PRICING,
    )
    prefix, encoders = "pre fix " * 700, {"words": str.split}
    assert costs.prefix_counts(rates, ["openai:chars", "openai:words"], prefix, encoders) == {"openai:chars": 5600, "openai:words": 1400}
    work = costs.deck_workload(costs.token_totals(blocks), batch_size=20, prefix_tokens=0)
    prefixes = costs.prefix_counts(rates, ["openai:chars", "openai:words"], prefix, encoders)
    got = {r["model"]: r for r in costs.price_alternatives(work, rates, ["openai:chars", "openai:words"], prefixes=prefixes).collect()}
    # Two requests: (prefix - 1024) is cached once.
    assert got["openai:chars"]["cached_in"] == 5600 - 1024 and got["openai:words"]["cached_in"] == 1400 - 1024


def test_a_report_names_unpriced_models(spark):
    blocks = spark.createDataFrame([("d", "x")], "deck_id string, text string")
    pricing = costs.default_pricing(spark)
    row = costs.deck_cost_report(blocks, pricing, reviewer="openai:gpt-4.1").first()
    assert row["priced"] is False and row["total_cost"] is None and row["producer_cost"] is not None
    assert costs.deck_cost_report(blocks, pricing).first()["priced"] is True


def test_one_encoder_counts_once(spark):
    blocks = spark.createDataFrame([("d", "one two")], "deck_id string, text string")
    same = costs.deck_cost_report(blocks, costs.default_pricing(spark), encoders={"o200k_base": str.split})
    assert same._jdf.queryExecution().executedPlan().toString().count("count(text") == 1 or "ArrowEvalPython [count(text" in same._jdf.queryExecution().executedPlan().toString()
    assert same.first()["tokens"] == 2
