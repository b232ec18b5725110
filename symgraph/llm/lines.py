"""Line dedup by site-relative frequency (native).

For each host, the share of its pages that contain a line; lines above ``ratio`` (and on
``min_pages`` pages at least) are boilerplate and are dropped from that host's pages.  Pages of a host
with equal texts count as one page, so copies of a page don't make its lines common.

Lines are counted by a 64-bit hash, beside a hash of their page's text.  A host can't have more than
(lines per page / ratio) boilerplate lines, so their hashes fit in a row; these rows are broadcast only
up to a counted number of hashes.  A page meets its host's hashes by one set intersection.

Defined results: a null text has no lines and stays null; blank lines stay; lines are compared
without the white space around them; a null host is a host; repeated rows count as one page; a page of
boilerplate only becomes an empty text; an empty table gives an empty result; further columns are passed
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import join_bounded, let, strip
from .scratch import materialize

RATIO = 0.02
MIN_PAGES = 5


def _line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(strip(x)))


def boilerplate(pages: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(__host, __lines): the hashes of the boilerplate lines of each host that has any."""
    lines = F.filter(F.split("text", "\n"), lambda x: strip(x) != "")
    own = pages.select(F.col(f"`{host}`").alias("__host"), F.xxhash64("text").alias("page"), lines.alias("lines"))
    seen = own.select("__host", "page", F.explode(F.array_distinct(_line_hashes(F.col("lines")))).alias("line")).distinct()
    often = seen.groupBy("__host", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    totals = materialize(own.select("__host", "page").distinct().groupBy("__host").agg(F.count("*").alias("total")), "line-totals")
    chosen = join_bounded(often, totals, ["__host"]).filter(F.col("pages") > ratio * F.col("total"))
    return materialize(chosen.groupBy("__host").agg(F.sort_array(F.collect_list("line")).alias("__lines")), "line-boilerplate")


def drop_boilerplate(
    pages: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` with cleaned ``text``, and n_lines and n_dropped as __n_lines and __n_dropped."""
    found = boilerplate(pages, host, ratio, min_pages)
    names = pages.columns
    joined = join_bounded(pages.withColumn("__host", F.col(f"`{host}`")), found, ["__host"], weight=F.size("__lines"))

    def cleaned(lines: Column) -> Column:
        def without(gone: Column) -> Column:
            kept = F.filter(lines, lambda x: ~F.array_contains(gone, F.xxhash64(strip(x))))
            size = F.size(lines).cast("bigint")
            some = let(kept, lambda k: F.struct(F.array_join(k, "\n").alias("text"), size.alias("n_lines"), (size - F.size(k)).alias("n_dropped")))
            return F.when(F.size(gone) > 0, some).otherwise(F.struct(F.col("text").alias("text"), size.alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped")))

        bad = F.coalesce(F.col("__lines"), F.array().cast("array<bigint>"))
        return let(F.array_intersect(_line_hashes(lines), bad), without)

    nothing = F.struct(F.col("text").alias("text"), F.lit(1).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"))
    done = joined.withColumn("__clean", F.when(F.col("text").isNull(), nothing).otherwise(let(F.split("text", "\n"), cleaned)))
    return done.select(
        *[F.col("__clean.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        F.col("__clean.n_lines").alias("__n_lines"),
        F.col("__clean.n_dropped").alias("__n_dropped"),
    )
