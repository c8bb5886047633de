"""Token and price arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscript import rules

MILLION = 1_000_000.0


def request_count(n_blocks: Column, batch_size: Column) -> Column:
    """Requests of ``batch_size`` blocks, one at least; a size below one means no batching."""
    batches = F.ceil(n_blocks / F.greatest(F.lit(1), batch_size))
    return F.when(batch_size < 1, F.lit(1)).otherwise(F.greatest(F.lit(1), batches)).cast("long")


def output_tokens(
    script_chars: Column, expansion: Column | float = rules.EXPANSION, chars_per_token: Column | float = rules.CHARS_PER_TOKEN
) -> Column:
    """Both roundings go to the even neighbour."""
    expansion = expansion if isinstance(expansion, Column) else F.lit(float(expansion))
    per_token = chars_per_token if isinstance(chars_per_token, Column) else F.lit(float(chars_per_token))
    target_chars = F.bround(script_chars * expansion, 0)
    return F.bround(target_chars / F.greatest(F.lit(1e-9), per_token), 0).cast("long")


def _discounted(prefix: Column) -> Column:
    return F.greatest(F.lit(0), prefix - rules.CACHED_PREFIX_FLOOR).cast("long")


def _no_discount(prefix: Column, n_requests: Column, no_cache: Column | bool) -> Column:
    """A prefix within the floor has no part to discount, so all input is billed."""
    no_cache = no_cache if isinstance(no_cache, Column) else F.lit(no_cache)
    return no_cache | (n_requests <= 1) | (prefix <= rules.CACHED_PREFIX_FLOOR)


def _dynamic(total_in: Column, prefix: Column, n_requests: Column) -> Column:
    return F.greatest(F.lit(0), total_in - prefix * n_requests)


def split_cached_input(
    total_in: Column, prefix: Column, n_requests: Column, no_cache: Column | bool = False
) -> Column:
    """``struct(uncached_in, cached_in)``: the repeated prefix is cheaper after the first call."""
    plain = _no_discount(prefix, n_requests, no_cache)
    return F.struct(
        F.when(plain, total_in).otherwise(_dynamic(total_in, prefix, n_requests) + prefix).cast("long").alias("uncached_in"),
        F.when(plain, 0).otherwise(_discounted(prefix) * (n_requests - 1)).cast("long").alias("cached_in"),
    )


def split_cached_read_write(
    total_in: Column,
    prefix: Column,
    n_requests: Column,
    no_cache: Column | bool = False,
    charge_write: Column | bool = False,
) -> Column:
    """``struct(uncached_in, cached_read, cached_write)``; ``charge_write`` bills the first prefix as a write."""
    charge = charge_write if isinstance(charge_write, Column) else F.lit(charge_write)
    plain = _no_discount(prefix, n_requests, no_cache)
    portion = _discounted(prefix)
    return F.struct(
        F.when(plain, total_in)
        .otherwise(_dynamic(total_in, prefix, n_requests) + F.when(charge, 0).otherwise(prefix))
        .cast("long")
        .alias("uncached_in"),
        F.when(plain, 0).otherwise(portion * (n_requests - 1)).cast("long").alias("cached_read"),
        F.when(~plain & charge, portion).otherwise(0).cast("long").alias("cached_write"),
    )


def input_parts(
    provider: Column,
    total_in: Column,
    prefix: Column,
    n_requests: Column,
    no_cache: bool = False,
    charge_write: bool = False,
) -> Column:
    """The provider's way of billing input, as one struct of four counts.

    Providers without a discount bill all input as uncached.
    """
    zero = F.lit(0).cast("long")
    cached = split_cached_input(total_in, prefix, n_requests, no_cache)
    written = split_cached_read_write(total_in, prefix, n_requests, no_cache, charge_write)

    def parts(uncached: Column, cached_in: Column, read: Column, write: Column) -> Column:
        return F.struct(
            uncached.alias("uncached_in"), cached_in.alias("cached_in"),
            read.alias("cached_read"), write.alias("cached_write"),
        )

    return (
        F.when(provider == "openai", parts(cached["uncached_in"], cached["cached_in"], zero, zero))
        .when(provider == "anthropic", parts(written["uncached_in"], zero, written["cached_read"], written["cached_write"]))
        .otherwise(parts(total_in.cast("long"), zero, zero, zero))
    )


def is_priced(price: Column) -> Column:
    """At least one rate of the pricing struct is known."""
    return F.coalesce(*[price[name] for name in ("in", "out", "in_cached", "cached_read", "cached_write")]).isNotNull()


def estimate_cost(parts: Column, out: Column, price: Column) -> Column:
    """Price of a workload; null when the model has no rates at all.

    A special rate that is zero or unknown gives way to the plain input rate.
    """
    def rate(name: str) -> Column:
        return F.when(price[name] != 0, price[name])

    base = F.coalesce(rate("in"), F.lit(0.0))
    total = (
        parts["uncached_in"] / MILLION * base
        + parts["cached_in"] / MILLION * F.coalesce(rate("in_cached"), base)
        + parts["cached_read"] / MILLION * F.coalesce(rate("cached_read"), base)
        + parts["cached_write"] / MILLION * F.coalesce(rate("cached_write"), base)
        + out / MILLION * F.coalesce(rate("out"), F.lit(0.0))
    )
    return F.when(is_priced(price), total)
