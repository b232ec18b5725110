"""Quality rules with thresholds that follow each language and source (native).

Base features come from whole texts, by columns only.  Each feature is then summarised per
(lang, source) in a log-bucket quantile sketch: values fall in buckets of relative width
``GAMMA``, and a sketch is a table of (bucket, count), so that sketches merge by adding counts,
in any order and with the same result.  Thresholds are fences read from the sketch, far beyond
the bulk of the group, so a group without outliers loses nothing.  Few documents say little, so a
group's fence is a mean of its own and its language's, and a language's of its own and that of all
documents; the wider sketch counts as much as ``PRIOR`` documents, at every size of the group.

Repeated words and lines are zero in most documents, so the quartiles of these ratios say nothing.
Their fences come from the values above zero, which are what is counted for the means; if there are
none at all, the least distance from the median is all there is.

Defined results: a null or empty text has no words and fails the base rules; null ``lang`` or
``source`` are groups like any other; rows with equal ``doc_id`` are judged one by one; an empty
table gives an empty result; columns beyond doc_id, text, lang, source are passed through by
``filter_quality`` and ignored by ``judge``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .native import SPACE, join_bounded, let, strip, words_of
from .scratch import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
GAMMA = 1.02
#: feature: (side, least distance of the fence from the median)
FENCES = {
    "symbol_ratio": ("high", 0.10),
    "repeat_ratio": ("high", 0.20),
    "dup_line_ratio": ("high", 0.50),
    "word_length_high": ("high", 4.0),
    "word_length_low": ("low", 0.75),
}
#: A fence stands this many times the distance from the median to the quartile beyond it.
REACH = 6.0
#: feature: (reach, least fence) among its values above zero
TAILS = {"repeat_ratio": (6.0, 0.10), "dup_line_ratio": (3.5, 0.15)}
#: How many documents the wider sketch counts as beside a group's own.
PRIOR = 50


def _repeat_words(words: Column) -> Column:
    """Words covered by a 5-word window that occurs twice or more in the list."""

    def marked(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(order: Column) -> Column:
            last = F.size(order) - 1
            same = F.filter(
                order,
                lambda x, i: ((i > 0) & (order[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]))
                | ((i < last) & (order[F.least(i + 1, last)]["h"] == x["h"])),
            )
            places = F.array_sort(F.transform(same, lambda x: x["i"]))
            start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
            return F.aggregate(
                places,
                start,
                lambda acc, p: F.struct(
                    (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).cast("bigint").alias("n"),
                    (p + WINDOW).cast("int").alias("end"),
                ),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            let(ranked, covered)
        )

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(hashes, marked))


def features(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id, lang, source, the base features and n_lines, a row for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    both = F.struct(
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
    )
    names = [c for c in ("doc_id", "lang", "source", *(extra or []))]
    measured = docs.select(
        *names,
        F.length(F.translate(text, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        both.alias("__m"),
    )
    return measured.select(
        *names,
        F.col("__m.w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("__m.l.n_dup_lines").alias("n_dup_lines"),
        F.col("__m.w.n_repeat_words").alias("n_repeat_words"),
        F.col("__m.l.n_lines").alias("n_lines"),
    ).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def _values() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    length = F.col("word_chars") / n
    return {
        "symbol_ratio": F.col("n_symbols") / n,
        "repeat_ratio": F.col("n_repeat_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "word_length_high": length,
        "word_length_low": length,
    }


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n): the quantile sketches of documents past the base rules."""
    parts = [
        F.struct(
            F.lit(name).alias("feature"),
            F.when(v < 1e-6, F.lit(-1_000_000)).otherwise(F.ceil(F.log(v) / math.log(GAMMA)).cast("int")).alias("bucket"),
        )
        for name, v in _values().items()
        if name != "word_length_low"
    ]
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*parts)).alias("p"))
    return rows.groupBy("lang", "source", F.col("p.feature").alias("feature"), F.col("p.bucket").alias("bucket")).agg(
        F.count("*").alias("n")
    )


def _quantiles(sketch: DataFrame, keys: list[str], at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    by = Window.partitionBy(*keys, "feature")
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.when(F.col("bucket") == -1_000_000, F.lit(0.0)).otherwise(
        2 * F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) / (GAMMA + 1)
    )
    run = sketch.withColumn("total", F.sum("n").over(by)).withColumn("upto", F.sum("n").over(upto)).withColumn("value", value)
    return run.groupBy(*keys, "feature").agg(
        F.max("total").alias("total"),
        *[F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("value"))).alias(f"q{round(100 * q)}") for q in at],
    )


def _with_tails(sketch: DataFrame) -> DataFrame:
    """``sketch`` and, as features of their own, the values above zero of the features in TAILS."""
    above = sketch.filter(F.col("feature").isin(*TAILS) & (F.col("bucket") > -1_000_000))
    return sketch.unionByName(above.withColumn("feature", F.concat("feature", F.lit("_tail"))))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """For each group: a fence for each feature, and the number of values that it comes from as ``n_`` and its name."""
    quantiles = _quantiles(_with_tails(sketch), keys)

    def fence(name: str, part: str, side: str, reach: float, least: float, tail: bool = False) -> list[Column]:
        spread = (F.col("q75") - F.col("q50")) if side == "high" else (F.col("q50") - F.col("q25"))
        if tail:
            edge = F.greatest(F.col("q50") + reach * spread, F.lit(least))
        else:
            away = F.greatest(reach * spread, F.lit(least))
            edge = F.col("q50") + away if side == "high" else F.col("q50") - away
        own = F.col("feature") == part
        return [F.max(F.when(own, edge)).alias(name), F.coalesce(F.max(F.when(own, F.col("total"))), F.lit(0)).alias(f"n_{name}")]

    columns = []
    for name, (side, least) in FENCES.items():
        columns += fence(name, "word_length_high" if name == "word_length_low" else name, side, REACH, least)
    for name, (reach, least) in TAILS.items():
        columns += fence(f"{name}_tail", f"{name}_tail", "high", reach, least, True)
    return quantiles.groupBy(*keys).agg(*columns)


def _tempered(own: str, wider: Column) -> Column:
    """The mean of a group's own fence and the wider one."""
    n = F.col(f"n_{own}")
    return (n * F.coalesce(F.col(own), F.lit(0.0)) + PRIOR * wider) / (n + PRIOR)


def thresholds(measured: DataFrame) -> DataFrame:
    """A row for each (lang, source) with its fences."""
    sketch = materialize(sketches(measured), "quality-sketch")
    tail_of = {k: f"{k}_tail" if k in TAILS else k for k in FENCES}

    def merged(*keys: str) -> DataFrame:
        return sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))

    whole = _fences(merged(), []).select(*[F.coalesce(F.col(tail_of[k]), F.col(k)).alias(f"all_{k}") for k in FENCES])
    langs = _fences(merged("lang"), ["lang"]).join(F.broadcast(whole))  # one row
    langs = materialize(langs.select("lang", *[_tempered(tail_of[k], F.col(f"all_{k}")).alias(f"lang_{k}") for k in FENCES]), "quality-languages")
    own = join_bounded(_fences(sketch, ["lang", "source"]), langs, ["lang"])
    return materialize(own.select("lang", "source", *[_tempered(tail_of[k], F.col(f"lang_{k}")).alias(k) for k in FENCES]), "quality-thresholds")


def _verdict(joined: DataFrame) -> DataFrame:
    values = _values()
    fine = ~F.col("base_failed")
    for name, (side, _) in FENCES.items():
        ok = values[name] <= F.col(name) if side == "high" else values[name] >= F.col(name)
        fine = fine & F.coalesce(ok, F.lit(True))
    return joined.withColumn("kept", fine).drop(*FENCES)


def judge(docs: DataFrame) -> DataFrame:
    """The base features and the verdict ``kept`` of each document."""
    measured = materialize(features(docs.select("doc_id", "text", "lang", "source")), "quality-features")
    return _verdict(join_bounded(measured, thresholds(measured), ["lang", "source"]))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged.

    Features are measured once and written beside their rows: texts aren't shuffled.
    """
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "doc_id", "text", "lang", "source")
    measured = materialize(features(whole, ["__row"]), "quality-features")
    kept = _verdict(join_bounded(measured, thresholds(measured.drop("__row")), ["lang", "source"])).filter("kept")
    return kept.select(*[F.col("__row")[c].alias(c) for c in names])
