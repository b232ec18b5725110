"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become letters in lower case with single spaces between runs of them; their one- to three-grams
are hashed to ``FEATURES`` buckets and weighted by TF-IDF.  Document frequencies come from all training
documents.  The regression is trained by follow-the-regularised-leader with elastic-net penalties on a
bounded sample, at most ``PER_LANGUAGE`` different documents of each language, those of the least hashes;
a fifth of it is held back and sets the temperature that calibrates the scores.  The model has a column
for each language, so the driver needs memory in proportion to their number.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if
there is nothing to learn from; rows with a null lang or id aren't learnt from; rows with equal ids are
predicted one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .native import join_bounded
from .scratch import materialize

FEATURES = 1 << 14
LONGEST = 3
#: Documents of each language that are trained on at most.
PER_LANGUAGE = 600
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
PASSES = 3
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None for a text without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    solid = _letters()[points]
    if not solid.any():
        return None
    points = np.where(solid, points, 32).astype(np.uint64)
    keep = solid.copy()
    keep[:-1] |= solid[1:]  # of a run of other characters one stays, before the next letter
    points = np.concatenate([points[keep], [np.uint64(32)]])
    hashed = np.zeros(len(points), np.uint64)
    counts = np.zeros(FEATURES, np.int64)
    for n in range(1, LONGEST + 1):
        hashed = (hashed[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + points[n - 1 :] + np.uint64(n)
        mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        counts += np.bincount((mixed >> np.uint64(50)).astype(np.int64), minlength=FEATURES)
    return counts


def _weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    return at, value / np.sqrt((value * value).sum())


def _training(docs: DataFrame, learns: Column) -> DataFrame:
    return docs.filter(learns & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Of each bucket, and the number of documents; a partition sends one row for each bucket it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                counts = grams(text.as_py())
                if counts is not None:
                    total[:-1] += counts > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(FEATURES + 1, np.int64)
    for r in found:
        total[r["bucket"]] = r["n"]
    return total[:-1], int(total[-1])


def _sample(rows: DataFrame, per_language: int) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(hash, language, buckets, counts) of the training sample."""
    marked = rows.withColumn("h", F.xxhash64("text", "lang"))
    # equal texts have one hash, so a share is one of different texts
    sizes = materialize(marked.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "language-sizes")
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    # twice as many as are needed, in expectation; of these, different ones are ranked without their texts
    some = join_bounded(marked.select("lang", "h"), sizes, ["lang"], how="inner").filter(unit < 2.0 * per_language / F.col("n"))
    ranked = some.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    wanted = materialize(ranked.filter(F.col("k") <= per_language).select("h", F.col("lang").alias("l")), "language-sample")
    chosen = join_bounded(marked, wanted.withColumnRenamed("l", "lang"), ["lang", "h"], how="inner")
    chosen = chosen.select("h", "lang", "text").dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, lang, text in zip(*(batch.column(k).to_pylist() for k in ("h", "lang", "text"))):
                counts = grams(text)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    out.append((h, lang, at.astype(np.uint16).tobytes(), np.minimum(counts[at], 65535).astype(np.uint16).tobytes()))
            if out:
                h, lang, at, n = zip(*out)
                yield pa.record_batch([pa.array(h, pa.int64()), pa.array(lang, pa.string()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["h", "lang", "at", "n"])

    made = chosen.mapInArrow(run, "h bigint, lang string, at binary, n binary").toArrow()
    rows_ = zip(*(made.column(k).to_pylist() for k in ("h", "lang", "at", "n")))
    return sorted(((h, lang, np.frombuffer(a, np.uint16), np.frombuffer(n, np.uint16)) for h, lang, a, n in rows_), key=lambda r: (r[0], r[1], r[2].tobytes()))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = grams(text)
        if counts is None or not self.languages:
            return "und", 0.0
        at, value = _weighted(counts, self.idf)
        p = _softmax((value @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, learns: Column, per_language: int = PER_LANGUAGE) -> Model:
    rows = _training(docs, learns)
    frequencies, n = document_frequencies(rows)
    idf = np.log((n + 1) / (frequencies + 1)) + 1
    sample = _sample(rows, per_language)
    languages = sorted({r[1] for r in sample})
    label = {k: i for i, k in enumerate(languages)}
    data = []
    for h, lang, at, counts in sample:
        value = (1 + np.log(counts)) * idf[at]
        data.append((h % 5 == 0, at, value / np.sqrt((value * value).sum()), label[lang]))
    k = max(1, len(languages))
    z, g2 = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) > L1, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2), 0.0)

    for _ in range(PASSES):
        for held, at, value, y in data:
            if held:
                continue
            at, value = np.append(at, FEATURES), np.append(value, 1.0)
            w = weights(at)
            p = _softmax(value @ w)
            p[y] -= 1
            g = np.outer(value, p)
            new = g2[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] = new
    final = weights(np.arange(FEATURES + 1))
    w, b = final[:-1], final[-1]
    held = [(value @ w[at] + b, y) for h, at, value, y in data if h]

    def loss(t: float) -> float:
        return -sum(float(np.log(_softmax(s / t)[y] + 1e-12)) for s, y in held)

    temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=loss) if held else 1.0
    return Model(languages, idf, w.astype(np.float32), b.astype(np.float32), temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row; only ``text`` is read for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
