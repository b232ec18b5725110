"""Ranking, grouping and answers cut to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import kept

#: Tokens of an answer that are left for the line that says what was omitted.
RESERVED = 40
BUDGETS = (120, 20_000)
DEFAULT_BUDGET = 1200


def tokens(text: Column) -> Column:
    """The estimate ceil(length / 4)."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def clamp_budget(asked: int | None) -> int:
    return DEFAULT_BUDGET if asked is None else max(BUDGETS[0], min(BUDGETS[1], int(asked)))


def within_budget(lines: DataFrame, budget: int, by: list[str], order: list, text: str = "line", parts: int = 64) -> DataFrame:
    """The leading lines of each group (``by``) whose costs, a token for the line break included, fit.

    A line costs a token at least, so no more lines than the budget's tokens can fit: of a group that many
    are taken first, in parts.
    """
    room = budget - RESERVED
    cost = tokens(F.col(text)) + 1
    head = first_per_group(lines, by, order, max(room, 0), parts).drop("rank", "in_group")
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return head.withColumn("cost", cost).withColumn("spent", F.sum(cost).over(run)).filter(F.col("spent") <= room)


#: Rows of a group that one task ranks, about.
GROUP_ROWS = 100_000


def parts_of(most: int) -> int:
    """The parts in which groups of up to ``most`` rows are ranked: small ones aren't moved twice."""
    return min(64, most // GROUP_ROWS + 1)


def first_per_group(rows: DataFrame, by: list[str], order: list, k: int, parts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group, with their rank and the group's size.

    A group is ranked in ``parts`` first, so that one with a third of all rows isn't one task's; the ranking
    that follows sees ``k`` rows of each part at most.  Groups in one part are ranked once.
    """
    if parts == 1:
        group = Window.partitionBy(*by)
        ranked = rows.withColumn("rank", F.row_number().over(group.orderBy(*order))).withColumn("in_group", F.count("*").over(group))
        return ranked.filter(F.col("rank") <= k)
    key = F.pmod(F.xxhash64(*[F.col(c) for c in order if isinstance(c, str)]), F.lit(parts))
    split = rows.withColumn("__part", key)
    inner = Window.partitionBy(*by, "__part")
    some = split.withColumn("__k", F.row_number().over(inner.orderBy(*order))).withColumn("__n", F.count("*").over(inner)).filter(F.col("__k") <= k)
    group = Window.partitionBy(*by)
    size = F.sum(F.when(F.col("__k") == 1, F.col("__n"))).over(group)
    ranked = some.withColumn("rank", F.row_number().over(group.orderBy(*order))).withColumn("in_group", size)
    return ranked.filter(F.col("rank") <= k).drop("__part", "__k", "__n")


def ordinals(rows: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Rows with an ordinal, from 1 within their group (``by``; all rows if it is empty), in order, nulls first.

    Rows are dealt by ranges of group and order, ranges count their groups, and a range's rows follow those of
    the ranges before it: a group of any size is many tasks'.  Rows that tie are ordered by a hash of all columns.
    """
    keys = [*by, *order, "__tie"]
    tied = rows.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    dealt = kept(tied.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).withColumn("__range", F.spark_partition_id()), "ordinals")
    counts = dealt.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__at")).groupBy(*[f"__{c}" for c in by], "__at").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*[f"__{c}" for c in by]) if by else Window.partitionBy(F.lit(0))  # a row for each range
    before = group.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = Window.partitionBy("__range", *by).orderBy(*[F.col(c).asc_nulls_first() for c in [*order, "__tie"]])
    placed = dealt.withColumn("__k", F.row_number().over(inside))
    on = placed["__range"] == starts["__at"]
    for c in by:
        on = on & placed[c].eqNullSafe(starts[f"__{c}"])
    joined = placed.join(starts, on)
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__before") + F.col("__k")).cast("bigint").alias(name))


def few_ordinals(rows: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """What ``ordinals`` gives, by a window over a group, for groups that are small: rows are shuffled once and not computed twice."""
    tied = rows.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    inside = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_first() for c in [*order, "__tie"]])
    return tied.withColumn(name, F.row_number().over(inside).cast("bigint")).drop("__tie")


def best(order: list[Column], value: str | Column) -> Column:
    """The value of the least row in ``order``, as an aggregate."""
    return F.min_by(value, F.struct(*order))
