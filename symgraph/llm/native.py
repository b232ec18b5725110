"""Column helpers shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once per row however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; a null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.array_remove(F.split(flat, " "), "")


def strip(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def join_bounded(
    big: DataFrame, small: DataFrame, keys: list[str], most: int = 50_000, salts: int = 64, how: str = "left", weight: Column | None = None
) -> DataFrame:
    """Left join of ``big`` with one row per key from ``small``, null keys being equal.

    ``small`` must be materialised.  If its rows, or the sum of their ``weight`` where rows have no fixed
    size, are at most ``most`` (counted here) it is broadcast; beyond that both sides are shuffled with a
    salt, a hash of the whole row, so that a key that holds a third of ``big`` is spread over ``salts`` tasks.
    """
    names = [c for c in small.columns if c not in keys]
    right = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *names)
    on = None
    for k in keys:
        same = big[k].eqNullSafe(right[f"__{k}"])
        on = same if on is None else on & same
    size = small.agg(F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0))).first()[0]
    if size <= most:
        return big.join(F.broadcast(right), on, how).drop(*[f"__{k}" for k in keys])
    plain = [f.name for f in big.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts)))
    spread = right.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    on = salted["__salt"] == spread["__other"]
    for k in keys:
        on = on & salted[k].eqNullSafe(spread[f"__{k}"])
    return salted.join(spread, on, how).drop("__salt", "__other", *[f"__{k}" for k in keys])
