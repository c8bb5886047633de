"""Temperature mixing of sources into a token budget.

Token shares of the sources are raised to an exponent between 0 (all alike) and 1 (as they are)
and normalised. The exponent is found by bisection: the largest that reaches the target entropy,
or, if that would repeat some source too often, the smallest that respects the repetition limit.
Every source then gets its weight's part of the budget: whole epochs, and of one more epoch the
first blocks of a permutation of its blocks, the last block cut at a document.

What decides over a document is a hash of its own and one row per source, so texts are not
shuffled and a source may hold any share of the corpus.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscript.llm.tables import content_key, staged, text_of
from twinscript.operators.joins import join_hot
from twinscript.operators.ordering import running_totals

SECTIONS, PASSES = 16, 10  # of the exponent's range per pass over the sources


@dataclass(frozen=True)
class Mix:
    """``budget`` is a share of the corpus's tokens.

    The target entropy lies ``gap`` of the way from the corpus's own to the largest possible one (all
    sources alike), so there is something to mix unless they are alike already. ``entropy``, a share of
    the largest possible one, names it outright.
    """

    gap: float = 0.5
    entropy: float | None = None
    max_repeats: float = 4.0
    budget: float = 1.0
    block_documents: int = 1024
    seed: int = 17


def word_count() -> Column:
    pieces = F.split(F.regexp_replace(text_of(), "[\\x09-\\x0D]", " "), " ")
    return F.size(F.array_remove(pieces, "")).cast("long")


def _source() -> Column:
    """A join key that keeps a null source apart from every named one."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))


def _row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), content_key())


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    return staged(docs.select(_source().alias("_source"), _row_hash(seed).alias("_own"), word_count().alias("_tokens")), "mixing")


def _at_exponents(sources: DataFrame, exponents: list[float], total: int, budget: float) -> list[tuple[float, float]]:
    """Entropy and largest repetition at each exponent, all in one aggregate over the sources."""
    log_share = F.log(F.col("tokens") / float(total))
    columns = []
    for i, a in enumerate(exponents):
        w = F.exp(a * log_share)
        columns += [F.sum(w).alias(f"s{i}"), F.sum(w * log_share).alias(f"e{i}"), F.max(w / F.col("tokens")).alias(f"m{i}")]
    row = sources.agg(*columns).first()
    out = []
    for i, a in enumerate(exponents):
        s = row[f"s{i}"]
        out.append((math.log(s) - a * row[f"e{i}"] / s, row[f"m{i}"] / s * budget))
    return out


def _last_true(holds, low: float, high: float) -> float:
    """Bisection in sections: the largest exponent at which ``holds``, which is true up to some point only."""
    for _ in range(PASSES):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        truth = holds(grid)
        if truth[-1]:
            return high
        if not truth[0]:
            return low
        k = truth.index(False)
        low, high = grid[k - 1], grid[k]
    return low


def exponent(sources: DataFrame, total: int, mix: Mix) -> float:
    """The exponent that meets the target entropy, raised as far as the repetition limit asks."""
    budget = mix.budget * total
    n = sources.count()
    largest = math.log(n) if n > 1 else 0.0
    own = _at_exponents(sources, [1.0], total, budget)[0][0]
    target = own + mix.gap * (largest - own) if mix.entropy is None else mix.entropy * largest
    even = _last_true(lambda grid: [h >= target - 1e-12 for h, _ in _at_exponents(sources, grid, total, budget)], 0.0, 1.0)
    # Repetition falls as the exponent grows; mirrored, the search above finds the smallest that holds.
    scarce = _last_true(lambda grid: [r <= mix.max_repeats for _, r in _at_exponents(sources, [1 - g for g in grid], total, budget)], 0.0, 1.0)
    return max(even, 1 - scarce)


def mixing_plan(measured: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per source: tokens, weight, quota, whole ``epochs``, and where the last epoch is cut."""
    counted = measured.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("documents"))
    counted = staged(counted.filter("tokens > 0"), "mixing-sources")
    total = counted.agg(F.sum("tokens")).first()[0]
    if not total:
        return counted.selectExpr("_source", "tokens", "0D AS weight", "0L AS quota", "0L AS epochs", "1L AS blocks", "0L AS cut_block", "0L AS cut_hash")
    alpha = exponent(counted, total, mix)
    log_share = F.log(F.col("tokens") / float(total))
    norm = counted.agg(F.sum(F.exp(alpha * log_share))).first()[0]
    weight = F.exp(alpha * log_share) / norm
    quota = F.floor(weight * (mix.budget * total) + 1e-6).cast("long")
    sources = counted.select(
        "_source", "tokens", weight.alias("weight"), quota.alias("quota"),
        F.ceil(F.col("documents") / mix.block_documents).cast("long").alias("blocks"),
    )
    sources = sources.withColumn("epochs", F.floor(F.col("quota") / F.col("tokens")).cast("long"))
    sources = staged(sources.withColumn("_rest", F.col("quota") - F.col("epochs") * F.col("tokens")), "mixing-sources")
    rows = join_hot(measured, sources.select("_source", "blocks", "_rest"), "_source").withColumn("_order", _block_order(mix.seed))
    blocks = rows.groupBy("_source", "_order").agg(F.sum("_tokens").alias("_size"), F.max("_rest").alias("_rest"))
    placed = running_totals(blocks, ["_source"], ["_order"], {"_upto": F.col("_size")})
    # The block that the rest of the budget ends in; every block before it is taken whole.
    cut = placed.filter("_upto > _rest AND _upto - _size <= _rest").select("_source", F.col("_order").alias("cut_block"), (F.col("_rest") - F.col("_upto") + F.col("_size")).alias("_left"))
    cut = staged(cut, "mixing-cut")
    inside = join_hot(rows.select("_source", "_order", "_own", "_tokens"), cut, "_source").filter(F.col("_order") == F.col("cut_block"))
    by_hash = inside.groupBy("_source", "_own").agg(F.sum("_tokens").alias("_size"), F.max("_left").alias("_left"))
    # One block a source is in here, a block_documents rows or so.
    upto = F.sum("_size").over(Window.partitionBy("_source").orderBy("_own").rowsBetween(Window.unboundedPreceding, 0))
    last = by_hash.withColumn("_upto", upto).filter("_upto <= _left").groupBy("_source").agg(F.max("_own").alias("cut_hash"))
    full = sources.join(cut.drop("_left"), "_source", "left").join(last, "_source", "left")
    return full.drop("_rest")


def _block_order(seed: int) -> Column:
    """Blocks are dealt by the row's hash; their order in the permutation is a hash of their number."""
    block = F.pmod(F.shiftright("_own", 20), F.col("blocks"))
    return F.xxhash64(F.lit(seed + 1), "_source", block)


def emitted(docs: DataFrame, plan: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Every emitted copy of every document: its columns, and ``_epoch``, ``_block``, ``_tokens``."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _source().alias("_source"), _row_hash(mix.seed).alias("_own"), word_count().alias("_tokens"))
    rows = join_hot(rows, plan.select("_source", "epochs", "blocks", "cut_block", "cut_hash"), "_source").withColumn("_block", _block_order(mix.seed))
    inside = (F.col("_block") == F.col("cut_block")) & (F.col("_own") <= F.col("cut_hash"))
    last = F.coalesce((F.col("_block") < F.col("cut_block")) | inside, F.lit(False))
    copies = F.col("epochs") + last.cast("long")
    return rows.filter(copies > 0).select("_row", "_tokens", "_block", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("_epoch"))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, epoch, block, n_tokens of every copy that the mixture holds.

    Tokens are words. A null source is a source of its own; a null text counts as empty. A source
    without a word gets no weight and no row. Rows alike in doc_id and text are taken together.
    Documents without words go with their block. Ties cannot occur but between such rows. An empty
    table gives an empty result. Columns besides doc_id, source and text are not read.
    """
    rows = docs.select("doc_id", "source", "text")
    plan = staged(mixing_plan(_measured(rows, mix.seed), mix), "mixing-plan")
    out = emitted(rows, plan, mix)
    return out.select("_row.doc_id", "_row.source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_tokens").alias("n_tokens"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mixture with all their columns, repeated as often as it repeats them."""
    plan = staged(mixing_plan(_measured(docs, mix.seed), mix), "mixing-plan")
    return emitted(docs, plan, mix).select("_row.*")
