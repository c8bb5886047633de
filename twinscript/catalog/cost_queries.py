"""Cost of decks: a source is a deck, a paragraph is a block, a character is a token."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.catalog import sql as q
from twinscript.catalog import workloads as w
from twinscript.catalog.registry import query
from twinscript.functions import cost
from twinscript.operators import costs

MODELS = ["openai:gpt-5", "anthropic:claude-sonnet-4", "google:gemini-2.0-flash", "openai:gpt-4.1"]
_PRICES = "pricing AS " + q.values(
    [(m, m.split(":")[0], *p, rules.DEFAULT_TOKENIZER) for m, p in rules.MODEL_PRICES.items()],
    'model, provider, "in", in_cached, out, cached_write, cached_read, tokenizer',
)
_WORK = (
    f"totals AS (SELECT deck_id, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS tokens, "
    f"CAST(sum({q.count('text', q.COST)}) AS BIGINT) AS script_chars FROM segments GROUP BY deck_id), "
    "work AS (SELECT *, CAST(greatest(1, ceil(n_blocks / 16)) AS BIGINT) AS n_requests, 2000 AS prefix_tokens, "
    "CAST(round_even(round_even(script_chars * 1.45::DOUBLE, 0) / 4.0::DOUBLE, 0) AS BIGINT) AS out_tokens FROM totals)"
)
_DYNAMIC = "greatest(0, tokens - prefix_tokens * n_requests)"
_PLAIN = "(n_requests <= 1 OR prefix_tokens <= 0)"


def _totals(spark, sf_dir) -> DataFrame:
    return costs.token_totals(w.segments(spark, sf_dir))


def _work(spark, sf_dir) -> DataFrame:
    return costs.deck_workload(_totals(spark, sf_dir), prefix_tokens=2000)


@query("token_totals", q.using("SELECT deck_id, n_blocks, tokens, script_chars FROM totals", _WORK))
def token_totals(spark, sf_dir):
    return _totals(spark, sf_dir)


@query(
    "tokenizer_hook",
    q.using(
        "SELECT deck_id, count(*) AS n_blocks, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS tokens, "
        f"CAST(sum({q.count('text', q.COST)}) AS BIGINT) AS script_chars FROM segments GROUP BY deck_id"
    ),
)
def tokenizer_hook(spark, sf_dir):
    """A caller's encoder in Arrow batches; here a token is what stands between blanks."""
    return costs.token_totals(w.segments(spark, sf_dir), costs.tokenizer(lambda text: text.split(" ")))


@query("request_count", q.using("SELECT deck_id, n_requests FROM work", _WORK))
def request_count(spark, sf_dir):
    return _totals(spark, sf_dir).select("deck_id", cost.request_count(F.col("n_blocks"), F.lit(16)).alias("n_requests"))


@query("output_tokens", q.using("SELECT deck_id, out_tokens FROM work", _WORK))
def output_tokens(spark, sf_dir):
    return _totals(spark, sf_dir).select("deck_id", cost.output_tokens(F.col("script_chars")).alias("out_tokens"))


@query(
    "split_cached_input",
    q.using(
        f"SELECT deck_id, CAST(CASE WHEN {_PLAIN} THEN tokens ELSE {_DYNAMIC} + prefix_tokens END AS BIGINT) AS uncached_in, "
        f"CAST(CASE WHEN {_PLAIN} THEN 0 ELSE (prefix_tokens - 1024) * (n_requests - 1) END AS BIGINT) AS cached_in FROM work",
        _WORK,
    ),
)
def split_cached_input(spark, sf_dir):
    split = cost.split_cached_input(F.col("tokens"), F.col("prefix_tokens"), F.col("n_requests"))
    return _work(spark, sf_dir).withColumn("s", split).select("deck_id", "s.*")


@query(
    "split_cached_read_write",
    q.using(
        f"SELECT deck_id, CAST(CASE WHEN {_PLAIN} THEN tokens ELSE {_DYNAMIC} END AS BIGINT) AS uncached_in, "
        f"CAST(CASE WHEN {_PLAIN} THEN 0 ELSE (prefix_tokens - 1024) * (n_requests - 1) END AS BIGINT) AS cached_read, "
        f"CAST(CASE WHEN {_PLAIN} THEN 0 ELSE prefix_tokens - 1024 END AS BIGINT) AS cached_write FROM work",
        _WORK,
    ),
)
def split_cached_read_write(spark, sf_dir):
    split = cost.split_cached_read_write(F.col("tokens"), F.col("prefix_tokens"), F.col("n_requests"), charge_write=True)
    return _work(spark, sf_dir).withColumn("s", split).select("deck_id", "s.*")


_PARTS = (
    "priced AS (SELECT w.*, p.*, "
    f"CAST(CASE WHEN provider NOT IN ('openai', 'anthropic') OR {_PLAIN} THEN tokens ELSE {_DYNAMIC} + prefix_tokens END AS BIGINT) AS uncached_in, "
    f"CAST(CASE WHEN provider <> 'openai' OR {_PLAIN} THEN 0 ELSE (prefix_tokens - 1024) * (n_requests - 1) END AS BIGINT) AS cached_in, "
    f"CAST(CASE WHEN provider <> 'anthropic' OR {_PLAIN} THEN 0 ELSE (prefix_tokens - 1024) * (n_requests - 1) END AS BIGINT) AS read_tokens, "
    "0::BIGINT AS write_tokens FROM work w CROSS JOIN pricing p)"
)


def _price(out: str = "out_tokens", p: str = "") -> str:
    def rate(name: str) -> str:
        return f'nullif(CAST({p}"{name}" AS DOUBLE), 0)'

    base = f"coalesce({rate('in')}, 0.0::DOUBLE)"
    million = "1000000.0::DOUBLE"
    return (
        f"(CASE WHEN coalesce({p}\"in\", {p}out, {p}in_cached, {p}cached_read, {p}cached_write) IS NOT NULL THEN "
        f"{p}uncached_in / {million} * {base} + {p}cached_in / {million} * coalesce({rate('in_cached')}, {base}) "
        f"+ {p}read_tokens / {million} * coalesce({rate('cached_read')}, {base}) "
        f"+ {p}write_tokens / {million} * coalesce({rate('cached_write')}, {base}) "
        f"+ {out} / {million} * coalesce({rate('out')}, 0.0::DOUBLE) END)"
    )


_ASKED = "(" + ", ".join(q.quote(m) for m in MODELS) + ")"


@query(
    "price_alternatives",
    q.using(
        "SELECT deck_id, model, uncached_in, cached_in, read_tokens AS cached_read, write_tokens AS cached_write, out_tokens, "
        "coalesce(\"in\", out, in_cached, cached_read, cached_write) IS NOT NULL AS priced, "
        f"round({_price()}, 10) AS cost FROM priced WHERE model IN {_ASKED}",
        _WORK, _PRICES, _PARTS,
    ),
)
def price_alternatives(spark, sf_dir):
    return costs.price_alternatives(_work(spark, sf_dir), costs.default_pricing(spark), MODELS).withColumn(
        "cost", F.round("cost", 10)
    )


def _deck_prices(spark, sf_dir) -> DataFrame:
    """Rates by part: models a corpus could be priced under."""
    part = w.table(spark, sf_dir, "part")
    special: Column = F.when(F.col("p_size") > 10, F.col("p_size") / 10)
    return part.select(
        F.concat(F.lit("part:"), "p_partkey").alias("model"),
        F.lit("part").alias("provider"),
        F.when(F.col("p_size") > 2, F.col("p_size") / 1.0).alias("in"),
        special.alias("in_cached"),
        F.when(F.col("p_size") > 2, F.col("p_size") * 4.0).alias("out"),
        F.lit(None).cast("double").alias("cached_write"),
        F.when(F.col("p_size") > 20, F.lit(0.0)).alias("cached_read"),
        F.col("p_type").alias("tokenizer"),
    )


_PART_PRICES = (
    "part_prices AS (SELECT 'part:' || p_partkey AS model, 'part' AS provider, CASE WHEN p_size > 2 THEN p_size / 1.0::DOUBLE END AS \"in\", "
    "CASE WHEN p_size > 10 THEN p_size / 10::DOUBLE END AS in_cached, CASE WHEN p_size > 2 THEN p_size * 4.0::DOUBLE END AS out, "
    "NULL::DOUBLE AS cached_write, CASE WHEN p_size > 20 THEN 0.0::DOUBLE END AS cached_read, p_type AS tokenizer, "
    "p_partkey + 1000 AS uncached_in, p_size * 7 AS cached_in, p_size * 3 AS read_tokens, p_size AS write_tokens FROM part)"
)


@query(
    "estimate_cost",
    q.using(f"SELECT model, round({_price('500')}, 8) AS cost FROM part_prices", _PART_PRICES),
)
def estimate_cost(spark, sf_dir):
    prices = _deck_prices(spark, sf_dir).withColumn("key", F.substring_index("model", ":", -1).cast("long"))
    size = w.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_size")
    parts = F.struct(
        (F.col("key") + 1000).alias("uncached_in"), (F.col("p_size") * 7).alias("cached_in"),
        (F.col("p_size") * 3).alias("cached_read"), F.col("p_size").alias("cached_write"),
    )
    price = F.struct("in", "in_cached", "out", "cached_write", "cached_read")
    return prices.join(size, "key").select(
        "model", F.round(cost.estimate_cost(parts, F.lit(500), price), 8).alias("cost")
    )


@query(
    "overlay_pricing",
    q.using(
        "SELECT model, provider, \"in\", out FROM part_prices WHERE tokenizer <> 'ECONOMY' UNION ALL "
        "SELECT model, 'new', 1.0::DOUBLE, NULL FROM part_prices WHERE tokenizer = 'ECONOMY'",
        _PART_PRICES,
    ),
)
def overlay_pricing(spark, sf_dir):
    base = _deck_prices(spark, sf_dir)
    unknown = F.lit(None).cast("double")
    overrides = base.filter(F.col("tokenizer") == "ECONOMY").withColumns(
        {"provider": F.lit("new"), "in": F.lit(1.0), "in_cached": unknown, "out": unknown, "cached_read": unknown}
    )
    return costs.overlay_pricing(base, overrides).select("model", "provider", "in", "out")


@query(
    "unknown_models",
    q.using(
        "SELECT DISTINCT 'part:' || l_partkey AS model FROM lineitem WHERE 'part:' || l_partkey NOT IN "
        "(SELECT model FROM part_prices WHERE \"in\" IS NOT NULL)",
        _PART_PRICES,
    ),
)
def unknown_models(spark, sf_dir):
    asked = w.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("model"))
    return costs.unknown_models(asked, _deck_prices(spark, sf_dir).filter(F.col("in").isNotNull()))


@query(
    "deck_cost_report",
    q.using(
        "SELECT deck_id, n_blocks, n_requests, script_chars, tokens, out_tokens, round(pc, 10) AS producer_cost, "
        "round(rc, 10) AS reviewer_cost, round(pc + rc, 10) AS total_cost, true AS priced FROM ("
        f"SELECT a.*, {_price('a.out_tokens', 'a.')} AS pc, {_price('0', 'b.')} AS rc "
        "FROM priced a JOIN priced b USING (deck_id) WHERE a.model = 'openai:gpt-5' AND b.model = 'openai:gpt-5-mini')",
        _WORK, _PRICES, _PARTS,
    ),
)
def deck_cost_report(spark, sf_dir):
    report = costs.deck_cost_report(w.segments(spark, sf_dir), costs.default_pricing(spark), prefix_tokens=2000)
    return report.withColumns({c: F.round(c, 10) for c in ("producer_cost", "reviewer_cost", "total_cost")})


# A producer without a rate for its cache, a reviewer with an encoder of its own, a model without any rate.
PREFIX = "Go on. " * 600
ENCODERS = {"words": lambda text: text.split(" ")}
FLOW_PRICES = [
    ("openai:chars", "openai", 2.0, None, 8.0, None, None, "o200k_base"),
    ("anthropic:words", "anthropic", 3.0, None, 15.0, 3.75, 0.3, "words"),
    ("openai:words", "openai", 1.0, 0.25, 4.0, None, None, "words"),
    ("openai:free", "openai", None, None, None, None, None, "words"),
]
_FLOW_PRICES = "pricing AS " + q.values(
    [(*p, len(ENCODERS.get(p[-1], list)(PREFIX))) for p in FLOW_PRICES],
    'model, provider, "in", in_cached, out, cached_write, cached_read, tokenizer, prefix_tokens',
)
_FLOW_WORK = (
    f"totals AS (SELECT deck_id, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words, "
    f"CAST(sum({q.count('text', q.COST)}) AS BIGINT) AS script_chars FROM segments GROUP BY deck_id), "
    "work AS (SELECT *, CAST(greatest(1, ceil(n_blocks / 10)) AS BIGINT) AS n_requests, "
    "CAST(round_even(round_even(script_chars * 1.45::DOUBLE, 0) / 4.0::DOUBLE, 0) AS BIGINT) AS out_tokens FROM totals)"
)


def _flow_parts(tokens: str) -> str:
    """Every deck under every model, its input counted as ``tokens`` says."""
    return _PARTS.replace("priced AS (SELECT w.*, p.*,", f"priced AS (SELECT w.*, p.*, {tokens} AS tokens,").replace(
        "FROM work w CROSS JOIN pricing p", f"FROM (SELECT w.*, p.*, {tokens} AS tokens FROM work w CROSS JOIN pricing p)"
    ).replace(f"SELECT w.*, p.*, {tokens} AS tokens,", "SELECT *,")


def _flow(spark, sf_dir, reviewer="anthropic:words"):
    from twinscript import schemas
    from twinscript.plans import flows
    from twinscript.session import small_table

    return flows.cost_estimate(
        w.segments(spark, sf_dir), small_table(spark, FLOW_PRICES, schemas.PRICING), also=[p[0] for p in FLOW_PRICES], prefix=PREFIX,
        producer="openai:chars", reviewer=reviewer, batch_size=10, encoders=ENCODERS,
    )


@query(
    "cost_estimate",
    q.using(
        "SELECT deck_id, n_blocks, n_requests, script_chars, chars AS tokens, out_tokens, round(pc, 10) AS producer_cost, "
        "round(rc, 10) AS reviewer_cost, round(pc + rc, 10) AS total_cost, true AS priced FROM ("
        f"SELECT a.*, {_price('a.out_tokens', 'a.')} AS pc, {_price('0', 'b.')} AS rc "
        "FROM priced a JOIN priced b USING (deck_id) WHERE a.model = 'openai:chars' AND b.model = 'anthropic:words')",
        _FLOW_WORK, _FLOW_PRICES, _flow_parts("CASE tokenizer WHEN 'words' THEN words ELSE chars END"),
    ),
)
def cost_estimate(spark, sf_dir):
    """The flow with an encoder for each model and the prefix as a text."""
    report = _flow(spark, sf_dir)[0]
    return report.withColumns({c: F.round(c, 10) for c in ("producer_cost", "reviewer_cost", "total_cost")})


@query(
    "cost_estimate_unpriced",
    q.using("SELECT deck_id, CAST(NULL AS DOUBLE) AS total_cost, false AS priced FROM totals", _FLOW_WORK),
)
def cost_estimate_unpriced(spark, sf_dir):
    """A reviewer without any rate."""
    return _flow(spark, sf_dir, "openai:free")[0].select("deck_id", "total_cost", "priced")


@query(
    "cost_estimate_alternatives",
    q.using(
        "SELECT deck_id, model, uncached_in, cached_in, read_tokens AS cached_read, write_tokens AS cached_write, out_tokens, "
        "coalesce(\"in\", out, in_cached, cached_read, cached_write) IS NOT NULL AS priced, "
        f"round({_price()}, 10) AS cost FROM priced",
        _FLOW_WORK, _FLOW_PRICES, _flow_parts("chars"),
    ),
)
def cost_estimate_alternatives(spark, sf_dir):
    """The producer's tokens under every model, the prefix in each model's own."""
    return _flow(spark, sf_dir)[1].withColumn("cost", F.round("cost", 10))
