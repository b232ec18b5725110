"""Document fingerprints by consistent weighted sampling (native).

A document is a bag of words, a word's weight is its count.  For each of K samples and each word,
r and c are Gamma(2, 1) draws and b is uniform, all fixed by (word, sample).  With weight w,
t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y exp r); the word with the least a wins the
sample, and (word, t) is the sample's value.  Two bags agree on a sample with probability
sum(min) / sum(max), their generalised Jaccard similarity.

Draws come from one 64-bit hash of (word, sample): sixteen bits pick r and sixteen pick c from a table of
evenly spread gamma draws, which is broadcast, and 32 make b.  Each sample is a running minimum of one long
(ln a above, a hash of (word, t) below), so a document's fingerprint is a plain aggregate.

Texts cross the network once, to stand beside the next document: documents go to buckets of
neighbouring ids, the first document of the next bucket comes along as a ghost row, and everything
after that is grouped inside the bucket, without another shuffle.

Defined results: a null text is an empty text; an empty bag has a fingerprint of its own, equal to
that of other empty bags only; rows with equal ids are ordered by text; null ids come last; of a
single row, the next document is the row itself; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .native import words_of

SAMPLES = 64
#: A draw is one of 2 ** BITS; the table of draws has a megabyte.
BITS = 16
ROWS_PER_BUCKET = 500
#: More would make the list of their edges, which is a part of the plan, large; beyond that buckets grow, sorted and spilled by their tasks.
MAX_BUCKETS = 1 << 16


def gamma_table(spark: SparkSession, bits: int = BITS) -> DataFrame:
    """One row: __r, 2 ** bits draws of Gamma(2, 1), and __c, their logarithms.

    A draw is -ln u - ln v; (u, v) run over a Hammersley set, whose points cover the square evenly,
    down to corners of 2 ** -bits.
    """
    n = 1 << bits
    mirrored = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("bigint")
    r = -F.log((F.col("id") + 0.5) / n) - F.log((mirrored + 0.5) / n)
    rows = spark.range(0, n, 1, 1).select("id", r.alias("r"))
    draws = F.transform(F.sort_array(F.collect_list(F.struct("id", "r"))), lambda v: v["r"])
    return rows.agg(draws.alias("__r")).select("__r", F.transform("__r", lambda x: F.log(x)).alias("__c"))


def sample_columns(samples: int = SAMPLES) -> list[Column]:
    """For each sample, the least (ln a, value) over a document's words, as one long.

    Reads __base, a hash of the word, __ln_w, the logarithm of its weight (null: no word), and the
    columns of ``gamma_table``.
    """
    base, ln_w, mask = F.col("__base"), F.col("__ln_w"), (1 << BITS) - 1
    out = []
    for k in range(samples):
        h = F.xxhash64(base, F.lit(k))
        r = F.get("__r", h.bitwiseAND(mask).cast("int"))
        c = F.get("__c", F.shiftrightunsigned(h, BITS).bitwiseAND(mask).cast("int"))
        b = F.shiftrightunsigned(h, 2 * BITS) / F.lit(float(1 << (64 - 2 * BITS)))
        t = F.floor(ln_w / r + b)
        ln_a = c - r * (t - b + 1.0)
        value = F.xxhash64(h, t).bitwiseAND(0xFFFFFFFF)
        packed = F.shiftleft((ln_a * F.lit(float(1 << 23))).cast("bigint"), 32).bitwiseOR(value)
        out.append(F.min(packed).alias(f"s{k}"))
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, doc_id, text, ghost, head: each document beside the text of the next by descending id."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    buckets = max(1, min(MAX_BUCKETS, n // ROWS_PER_BUCKET))
    shares = [i / buckets for i in range(1, buckets + 1)]
    cuts, top_id = rows.agg(F.percentile_approx("doc_id", shares, 10 * buckets), F.max("doc_id")).first()
    # the greatest id of each bucket; these ids exist
    edges = sorted({e for e in cuts or [] if e < top_id} | {0 if top_id is None else top_id})
    array = F.from_json(F.lit(str(edges)), "array<bigint>")
    last = len(edges) - 1
    # bucket 0 has the lowest ids and, after them, the null ids
    own = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(
        F.least(F.lit(last), _position(array, F.col("doc_id"), len(edges)))
    )
    is_edge = F.col("doc_id") == F.get(array, F.col("own"))
    top = F.col("doc_id") == F.lit(edges[last])
    # the greatest of bucket i is next after the least of bucket i + 1; the greatest of all is next after the last of all
    ghosts = F.when(top, F.lit(0)).when(is_edge, F.col("own") + 1)
    placed = rows.withColumn("own", own)
    homes = F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ghost")), F.when(ghosts.isNotNull() if last else top, F.struct(ghosts.cast("int").alias("bucket"), F.lit(True).alias("ghost")))))
    both = placed.select("doc_id", "text", F.explode(homes).alias("home")).select("doc_id", "text", "home.bucket", "home.ghost")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return both.withColumn("head", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))


def _position(edges: Column, value: Column, n: int) -> Column:
    """The index of the first edge not below ``value``, by halving."""
    steps = [F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))]
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda low, step: F.when((low + step <= n) & (F.get(edges, low + step - 1) < value), low + step).otherwise(low),
    )


def fingerprint_neighbours(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    placed = with_next(docs)
    edited = F.expr(
        "concat(substring(text, 1, length(text) - cast(floor(length(text) / 2) as int)),"
        " substring(coalesce(head, ''), 1, cast(floor(length(text) / 2) as int)))"
    )
    whole = placed.select("bucket", "place", "ghost", "doc_id", "text", edited.alias("edited"))
    about = whole.filter(~F.col("ghost")).select(
        "bucket",
        F.col("place").alias("at"),
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
    )
    # the text of place p has key 2 p, its edited text 2 p + 1
    texts = F.array(
        F.struct((2 * F.col("place")).alias("key"), F.col("text").alias("t")),
        F.struct((2 * F.col("place") + 1).alias("key"), F.col("edited").alias("t")),
    )
    words = whole.select("bucket", F.explode(texts).alias("s")).select(
        "bucket", "s.key", F.explode_outer(words_of(F.col("s.t"))).alias("word")
    )
    counted = words.groupBy("bucket", "key", "word").agg(F.count("word").alias("weight"))
    drawn = counted.select(
        "bucket",
        "key",
        F.xxhash64("word").alias("__base"),
        F.when(F.col("weight") > 0, F.log(F.col("weight").cast("double"))).alias("__ln_w"),
    )
    drawn = drawn.join(F.broadcast(gamma_table(docs.sparkSession)))  # one row of fixed size
    signed = drawn.groupBy("bucket", "key").agg(*sample_columns(samples))
    values = F.array(*[F.coalesce(F.col(f"s{k}").bitwiseAND(0xFFFFFFFF), F.lit(-1).cast("bigint")) for k in range(samples)])
    order = Window.partitionBy("bucket").orderBy("key")
    chained = (
        signed.select("bucket", "key", values.alias("v0"))
        .withColumn("v1", F.lead("v0").over(order))
        .withColumn("v2", F.lead("v0", 2).over(order))
        .filter(F.col("key") % 2 == 0)
        .withColumn("at", (F.col("key") / 2).cast("int"))
        .join(about, ["bucket", "at"])
    )

    def likeness(a: str, b: str) -> Column:
        same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
        return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.lit(float(samples))

    def text_of(v: str) -> Column:
        return F.array_join(F.transform(v, lambda x: F.when(x < 0, F.lit("-" * 8)).otherwise(F.lpad(F.lower(F.hex(x)), 8, "0"))), "")

    return chained.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of("v0").alias("fingerprint"),
        text_of("v1").alias("edited_fingerprint"),
        likeness("v0", "v1").alias("near_edited"),
        likeness("v0", "v2").alias("near_next"),
    )
