"""Cost of translating decks under different models."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from twinscript import rules, schemas
from twinscript.functions.cost import estimate_cost, input_parts, is_priced, output_tokens, request_count
from twinscript.functions.script import count_script_chars
from twinscript.session import small_table

PRODUCER = "openai:gpt-5"
RATES = ["in", "in_cached", "out", "cached_write", "cached_read"]


def default_pricing(spark: SparkSession) -> DataFrame:
    rows = [(m, m.split(":")[0], *prices, rules.DEFAULT_TOKENIZER) for m, prices in rules.MODEL_PRICES.items()]
    return small_table(spark, rows, schemas.PRICING)


def overlay_pricing(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides replace whole rows; their unknown rates stay unknown."""
    return base.join(overrides.select("model"), "model", "left_anti").unionByName(overrides)


def unknown_models(models: DataFrame, pricing: DataFrame) -> DataFrame:
    return models.select("model").distinct().join(pricing.select("model"), "model", "left_anti")


def tokenizer(encode: Callable[[str], list] | None = None) -> Callable[[Column], Column]:
    """A token counter: characters by default, or a caller's encoder in Arrow batches."""
    if encode is None:
        return lambda text: F.length(text).cast("long")

    import pandas as pd

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t)))

    return count


Encoder = Callable[[str], list]


def encoder_for(name: str | None, encoders: dict[str, Encoder] | None = None) -> Encoder | None:
    """A named encoding; unknown names fall back to the default one, then to none (a token a character)."""
    encoders = encoders or {}
    return encoders.get(name, encoders.get(rules.DEFAULT_TOKENIZER))


def tokenizer_for(name: str | None, encoders: dict[str, Encoder] | None = None) -> Callable[[Column], Column]:
    """The counter of a named encoding (:func:`encoder_for`)."""
    return tokenizer(encoder_for(name, encoders))


def prefix_counts(pricing: DataFrame, models: list[str], prefix: str, encoders: dict[str, Encoder] | None = None) -> dict[str, int]:
    """Tokens of a repeated prefix for each of the models, by the encoder its price row names."""
    rows = _price_rows(pricing, models)
    return {r["model"]: len((encoder_for(r["tokenizer"], encoders) or list)(prefix)) for r in rows}


def token_totals(
    blocks: DataFrame,
    count_tokens: Callable[[Column], Column] | None = None,
    cls: str = rules.SCRIPT_COST,
    **more: Callable[[Column], Column],
) -> DataFrame:
    """Blocks, tokens and source-script characters per deck.

    ``more`` adds a column of tokens per further counter.
    """
    counters = {"tokens": count_tokens or tokenizer(), **more}
    return blocks.groupBy("deck_id").agg(
        F.count("*").alias("n_blocks"),
        *[F.sum(count(F.col("text"))).alias(name) for name, count in counters.items()],
        F.sum(count_script_chars(F.col("text"), cls)).alias("script_chars"),
    )


def _price_rows(pricing: DataFrame, models: list[str]) -> list[Row]:
    """The asked-for price rows; there are as many as the caller named."""
    known = {r["model"]: r for r in pricing.filter(F.col("model").isin(models)).collect()}
    missing = [m for m in models if m not in known]
    if missing:
        raise ValueError(f"unknown model: {', '.join(missing)}")
    return [known[m] for m in models]


def producer_tokenizer(
    pricing: DataFrame, producer: str | None = None, encoders: dict[str, Callable[[str], list]] | None = None
) -> Callable[[Column], Column]:
    """The counter of the encoding that the producer's price row names."""
    (row,) = _price_rows(pricing, [producer or PRODUCER])
    return tokenizer_for(row["tokenizer"], encoders)


def _literal(row: Row) -> Column:
    text = ("model", "provider", "tokenizer")
    return F.struct(
        *[F.lit(row[c]).cast("string").alias(c) for c in text], *[F.lit(row[c]).cast("double").alias(c) for c in RATES]
    )


def deck_workload(
    totals: DataFrame,
    batch_size: int = rules.REQUEST_BATCH,
    prefix_tokens: int = 0,
    expansion: float = rules.EXPANSION,
    chars_per_token: float = rules.CHARS_PER_TOKEN,
    keep: list[str] | None = None,
) -> DataFrame:
    """Token totals with requests and estimated output."""
    return totals.select(
        "deck_id",
        *(keep or []),
        "n_blocks",
        "script_chars",
        "tokens",
        request_count(F.col("n_blocks"), F.lit(batch_size)).alias("n_requests"),
        F.lit(prefix_tokens).cast("long").alias("prefix_tokens"),
        output_tokens(F.col("script_chars"), expansion, chars_per_token).alias("out_tokens"),
    )


def price_alternatives(
    workload: DataFrame, pricing: DataFrame, models: list[str], no_cache: bool = False, charge_write: bool = False,
    prefixes: dict[str, int] | None = None,
) -> DataFrame:
    """Each workload under each of the models; ``priced`` is false where no rate is known.

    The tokens are the workload's; ``prefixes`` (:func:`prefix_counts`) gives the prefix in
    each model's own tokens, and models it lacks take the workload's.
    """
    price = F.col("_p")
    prefix = F.coalesce(F.col("_prefix"), F.col("prefix_tokens"))
    parts = input_parts(price["provider"], F.col("tokens"), prefix, F.col("n_requests"), no_cache, charge_write)
    asked = [
        F.struct(_literal(r).alias("p"), F.lit((prefixes or {}).get(r["model"])).cast("long").alias("prefix"))
        for r in _price_rows(pricing, models)
    ]
    return (
        workload.withColumn("_m", F.explode(F.array(*asked)))
        .withColumns({"_p": F.col("_m.p"), "_prefix": F.col("_m.prefix")})
        .withColumn("_parts", parts)
        .select(
            "deck_id",
            F.col("_p.model").alias("model"),
            "_parts.*",
            "out_tokens",
            is_priced(price).alias("priced"),
            estimate_cost(F.col("_parts"), F.col("out_tokens"), price).alias("cost"),
        )
    )


def deck_cost_report(
    blocks: DataFrame,
    pricing: DataFrame,
    producer: str = PRODUCER,
    reviewer: str = "openai:gpt-5-mini",
    batch_size: int = rules.REQUEST_BATCH,
    prefix_tokens: int = 0,
    expansion: float = rules.EXPANSION,
    chars_per_token: float = rules.CHARS_PER_TOKEN,
    no_cache: bool = False,
    charge_write: bool = False,
    encoders: dict[str, Encoder] | None = None,
    reviewer_prefix_tokens: int | None = None,
    prefix: str | None = None,
) -> DataFrame:
    """One row per deck: size, requests, and what producing and reviewing it costs.

    The reviewer reads the same input and answers with next to nothing. Each model
    counts tokens with the encoder its price row names, when ``encoders`` has it; blocks
    are counted once for each encoder. ``prefix`` is the text that every request repeats,
    in place of its numbers of tokens. ``priced`` is false where one of the models has no
    rate; its costs are null.
    """
    if prefix is not None:
        counts = prefix_counts(pricing, [producer, reviewer], prefix, encoders)
        prefix_tokens, reviewer_prefix_tokens = counts[producer], counts[reviewer]
    producing, reviewing = _price_rows(pricing, [producer, reviewer])
    ways = [encoder_for(r["tokenizer"], encoders) for r in (producing, reviewing)]
    if ways[0] is ways[1]:
        totals = token_totals(blocks, tokenizer(ways[0])).withColumn("reviewer_tokens", F.col("tokens"))
    else:
        totals = token_totals(blocks, tokenizer(ways[0]), reviewer_tokens=tokenizer(ways[1]))
    work = deck_workload(totals, batch_size, prefix_tokens, expansion, chars_per_token, keep=["reviewer_tokens"])

    def cost(row: Row, tokens: str, prefix: Column, out: Column) -> Column:
        price = _literal(row)
        parts = input_parts(price["provider"], F.col(tokens), prefix, F.col("n_requests"), no_cache, charge_write)
        return estimate_cost(parts, out, price)

    reviewer_prefix = F.lit(prefix_tokens if reviewer_prefix_tokens is None else reviewer_prefix_tokens)
    return (
        work.withColumn("producer_cost", cost(producing, "tokens", F.col("prefix_tokens"), F.col("out_tokens")))
        .withColumn("reviewer_cost", cost(reviewing, "reviewer_tokens", reviewer_prefix, F.lit(0)))
        .select(
            "deck_id", "n_blocks", "n_requests", "script_chars", "tokens", "out_tokens", "producer_cost", "reviewer_cost",
            (F.col("producer_cost") + F.col("reviewer_cost")).alias("total_cost"),
            (is_priced(_literal(producing)) & is_priced(_literal(reviewing))).alias("priced"),
        )
    )
