"""An index that follows a stream of file changes.

A record says what a file was at a time: path, ts, size, mtime_ms, hash, lang and text, or a null hash if it is
gone.  Each batch is collapsed to the last state of each path, compared with the states that the index was made
of, and applied.  The states are a table of the index, so a restart goes on from what is stored.

A batch writes a version of its own and then names it in ``current``; a batch that is delivered again after
that is skipped, and one that failed before is written anew.  So answers always come from a whole version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index as indexing
from ..operators import store, upkeep
from ..operators.index import Index
from ..tables import kept, scope

STATES = "path string, size bigint, mtime_ms bigint, hash string"
RECORDS = "path string, ts timestamp, size bigint, mtime_ms bigint, hash string, lang string, text string"


def current(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """The number and the folder of the last whole version."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    number = spark.read.schema("number bigint").parquet(f"{folder}/current").agg(F.max("number")).first()[0]
    return number, f"{folder}/v{number}"


def index_of(spark: SparkSession, folder: str) -> Index:
    return upkeep.load(spark, current(spark, folder)[1])


def plan(batch: DataFrame, states: DataFrame) -> DataFrame:
    """(path, action, size, mtime_ms, hash, lang, text) of the last state of each path.

    same: size and time are those known; touch: only they differ; parse: the hash does; delete: it is gone.
    """
    last = store.upsert(batch, ["path"], [F.col("ts"), F.coalesce("hash", F.lit(""))])
    was = states.select("path", F.col("size").alias("s0"), F.col("mtime_ms").alias("m0"), F.col("hash").alias("h0"))
    action = (
        F.when(F.col("hash").isNull(), F.when(F.col("h0").isNotNull(), "delete").otherwise("same"))
        .when(F.col("size").eqNullSafe(F.col("s0")) & F.col("mtime_ms").eqNullSafe(F.col("m0")), "same")
        .when(F.col("hash").eqNullSafe(F.col("h0")), "touch")
        .otherwise("parse")
    )
    return last.join(was, "path", "left").select("path", action.alias("action"), "size", "mtime_ms", "hash", "lang", "text")


def apply_batch(spark: SparkSession, batch: DataFrame, number: int, folder: str) -> None:
    """Applies a batch of records to the index in ``folder`` as version ``number``."""
    last = current(spark, folder)
    if last is not None and last[0] >= number:
        return
    with scope():
        known = spark.createDataFrame([], STATES) if last is None else spark.read.schema(STATES).parquet(f"{last[1]}/states")
        planned = kept(plan(batch, known).filter("action <> 'same'"), "plan")
        parsed = planned.filter("action = 'parse'").select("path", "lang", "text")
        gone = planned.filter("action = 'delete'").select("path")
        target = f"{folder}/v{number}"
        if last is None:
            made = indexing.build(parsed)
        elif planned.filter("action <> 'touch'").isEmpty():
            made = upkeep.load(spark, last[1])  # a touched file is what it was
        else:
            made = upkeep.apply(upkeep.load(spark, last[1]), parsed, gone)
        upkeep.save(made, target)
        states = store.delete_paths(known, planned.select("path")).unionByName(planned.filter("action <> 'delete'").select("path", "size", "mtime_ms", "hash"))
        states.write.mode("overwrite").parquet(f"{target}/states")
        spark.range(1).select(F.lit(number).cast("bigint").alias("number")).coalesce(1).write.mode("append").parquet(f"{folder}/current")


def follow(records: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts applying a stream of records to the index in ``folder``; what is there already is taken batch by batch."""
    spark = records.sparkSession
    writer = records.writeStream.foreachBatch(lambda batch, number: apply_batch(spark, batch, number, folder))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
