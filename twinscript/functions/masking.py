"""Fragile spans (links, numbers, codes) behind placeholders, and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscript import rules
from twinscript.functions.text import let, matches, splice

STAGES = (("URL", rules.FRAGILE_URL), ("NUM", rules.FRAGILE_NUMBER), ("CODE", rules.FRAGILE_CODE))

# No pattern above matches a text without any of these.
MAY_BE_FRAGILE = r"(?U)\d|@|https?://"


PLACEHOLDER = r"⟦(?:URL|NUM|CODE)_(\d+)⟧"
COUNTED_DIGITS = 9  # a longer number is none that a counter reaches


def _placeholder(tag: str, i: Column) -> Column:
    return F.concat(F.lit(f"⟦{tag}_"), (i + 1).cast("string"), F.lit("⟧"))


def _taken(text: Column) -> Column:
    """The largest number of a placeholder that stands in the text already."""
    numbers = F.transform(
        F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)),
        lambda n: F.when(F.length(n) <= COUNTED_DIGITS, n.try_cast("int")),
    )
    return F.when(text.contains("⟦"), F.coalesce(F.array_max(numbers), F.lit(0))).otherwise(F.lit(0))


def mask_fragile(text: Column) -> Column:
    """``struct(masked string, marks map<string,string>)``.

    Links go first, then numbers, then codes; each tag counts from one, or from past
    the largest placeholder that the text itself holds, which so stays what it is.
    Later stages do not look inside placeholders.
    """
    none = F.array().cast("array<string>")
    unmasked = F.struct(text.alias("masked"), F.map_from_arrays(none, none).alias("marks"))
    state = F.struct(text.alias("masked"), none.alias("keys"), none.alias("spans"), _taken(text).alias("taken"))

    def apply_stage(s: Column, tag: str, pattern: str) -> Column:
        text = s["masked"]

        def put(hits: Column) -> Column:
            return F.struct(
                splice(text, pattern, lambda hit, i: F.when(hit.isNotNull(), _placeholder(tag, i + s["taken"])), hits).alias("masked"),
                F.concat(s["keys"], F.transform(hits, lambda _, i: _placeholder(tag, i + s["taken"]))).alias("keys"),
                F.concat(s["spans"], hits).alias("spans"),
                s["taken"].alias("taken"),
            )

        return let(matches(text, pattern), lambda hits: F.when(F.size(hits) == 0, s).otherwise(put(hits)))

    def staged(tag: str, pattern: str):
        return lambda s: apply_stage(s, tag, pattern)

    for tag, pattern in STAGES:
        state = let(state, staged(tag, pattern))
    masked = let(
        state,
        lambda s: F.struct(
            s["masked"].alias("masked"),
            F.map_from_arrays(s["keys"], s["spans"]).alias("marks"),
        ),
    )
    return F.when(text.rlike(MAY_BE_FRAGILE), masked).otherwise(unmasked)


def unmask_fragile(masked: Column, marks: Column) -> Column:
    return F.aggregate(
        F.map_entries(marks),
        masked,
        lambda s, e: F.replace(s, e.getField("key"), e.getField("value")),
    )


def placeholders(text: Column) -> Column:
    """The placeholders of a text, sorted."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))
