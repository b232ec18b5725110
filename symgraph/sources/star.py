"""A graph over the sales tables: every row of a dimension is a symbol, every foreign key a relationship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONFIDENCES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, qualified, kind, path, lang, line_start, exported."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    places = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])  # 25 rows by definition
    at = places.select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("at"))

    def part(df, kind, id_, name, path, lang, line, exported, qualified=None):
        return df.select(
            id_.alias("id"),
            name.alias("name"),
            (qualified if qualified is not None else name).alias("qualified"),
            F.lit(kind).alias("kind"),
            path.alias("path"),
            F.lit(lang).alias("lang"),
            line.cast("bigint").alias("line_start"),
            exported.alias("exported"),
        )

    customer = table(spark, sf_dir, "customer").join(F.broadcast(at), F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(at), F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [
        part(region, "module", _id("region", "r_regionkey"), F.col("r_name"), F.col("r_name"), "sql", F.lit(1), F.lit(True)),
        part(places, "module", _id("nation", "n_nationkey"), F.col("n_name"), F.concat_ws("/", "r_name", "n_name"), "sql", F.lit(1), F.lit(True)),
        part(customer, "class", _id("customer", "c_custkey"), F.col("c_name"), F.concat("at", F.lit("/customer")), "java", F.col("c_custkey") % 1000 + 1, F.col("c_acctbal") > 0),
        part(supplier, "struct", _id("supplier", "s_suppkey"), F.col("s_name"), F.concat("at", F.lit("/supplier")), "go", F.col("s_suppkey") % 1000 + 1, F.col("s_acctbal") > 0),
        part(
            table(spark, sf_dir, "part"), "constant", _id("part", "p_partkey"), F.col("p_name"),
            F.concat(F.lit("part/"), (F.col("p_partkey") % 10).cast("string")), "python", F.col("p_partkey") % 1000 + 1,
            F.col("p_size") > 25, F.concat_ws(".", "p_brand", "p_name"),
        ),
        part(
            table(spark, sf_dir, "orders"), "function", _id("orders", "o_orderkey"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")),
            F.concat(F.lit("orders/"), (F.col("o_orderkey") % 100).cast("string")), "typescript", F.col("o_orderkey") % 1000 + 1, F.col("o_orderstatus") == "F",
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Line items that a task groups, about; a task's memory doesn't grow with the table.
TASK_ROWS = 500_000


def edges(spark: SparkSession, sf_dir: str, to: tuple[str, ...] | None = None, at: tuple[str, ...] | None = None) -> DataFrame:
    """src_id, dst_id, type, confidence, path, line.  Of parallel line items the strongest evidence counts.

    ``to`` leaves out relationships that point at symbols of other kinds, before they are made; ``at`` those that
    have symbols of other kinds at both ends.
    """
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    strongest = F.array(*[F.lit(c) for c in CONFIDENCES])[F.min("rank")]
    items = table(spark, sf_dir, "lineitem").withColumn("rank", rank)
    wanted = lambda kind, src: (to is None or kind in to) and (at is None or kind in at or src in at)
    # few items share a pair, so they are dealt before they are grouped, to as many tasks as there are rows for
    tasks = max(spark.sparkContext.defaultParallelism, items.count() // TASK_ROWS + 1) if wanted("struct", "function") or wanted("constant", "function") else 1

    def bound(dst: str, key: str, type_: str) -> DataFrame:
        pairs = items.select("l_orderkey", key, "rank").repartition(tasks, "l_orderkey", key).groupBy("l_orderkey", key).agg(strongest.alias("confidence"))
        return pairs.select(
            _id("orders", "l_orderkey").alias("src_id"), _id(dst, key).alias("dst_id"), F.lit(type_).alias("type"), "confidence",
            F.concat(F.lit("orders/"), (F.col("l_orderkey") % 100).cast("string")).alias("path"), (F.col("l_orderkey") % 1000 + 1).alias("line"),
        )

    def plain(name: str, src, dst, type_: str, path, line) -> DataFrame:
        return table(spark, sf_dir, name).select(
            src.alias("src_id"), dst.alias("dst_id"), F.lit(type_).alias("type"), F.lit("exact").alias("confidence"), path.alias("path"), line.cast("bigint").alias("line")
        )

    order_path = F.concat(F.lit("orders/"), (F.col("o_orderkey") % 100).cast("string"))
    out = []
    if wanted("module", "module"):
        out.append(plain("nation", _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "references", F.lit("nation"), F.lit(1)))
        out.append(plain("nation", _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "defines", F.lit("region"), F.lit(1)))
    if wanted("module", "class"):
        out.append(plain("customer", _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "references", F.lit("customer"), F.col("c_custkey") % 1000 + 1))
    if wanted("module", "struct"):
        out.append(plain("supplier", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "references", F.lit("supplier"), F.col("s_suppkey") % 1000 + 1))
    if wanted("class", "function"):
        out.append(plain("orders", _id("orders", "o_orderkey"), _id("customer", "o_custkey"), "calls", order_path, F.col("o_orderkey") % 1000 + 1))
    if wanted("struct", "function"):
        out.append(bound("supplier", "l_suppkey", "calls"))
    if wanted("constant", "function"):
        out.append(bound("part", "l_partkey", "queries"))
    return reduce(DataFrame.unionByName, out)


#: The same two tables in SQL, to stand before a query.
SQL = """
WITH RECURSIVE places AS (
  SELECT n_nationkey, r_name || '/' || n_name AS spot FROM nation JOIN region ON n_regionkey = r_regionkey
), nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, r_name AS qualified, 'module' AS kind, r_name AS path, 'sql' AS lang, CAST(1 AS BIGINT) AS line_start, true AS exported FROM region
  UNION ALL SELECT 'nation:' || nation.n_nationkey, n_name, n_name, 'module', spot, 'sql', 1, true FROM nation JOIN places USING (n_nationkey)
  UNION ALL SELECT 'customer:' || c_custkey, c_name, c_name, 'class', spot || '/customer', 'java', c_custkey % 1000 + 1, c_acctbal > 0 FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, s_name, 'struct', spot || '/supplier', 'go', s_suppkey % 1000 + 1, s_acctbal > 0 FROM supplier JOIN places ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, p_name, p_brand || '.' || p_name, 'constant', 'part/' || (p_partkey % 10), 'python', p_partkey % 1000 + 1, p_size > 25 FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'Order#' || o_orderkey, 'Order#' || o_orderkey, 'function', 'orders/' || (o_orderkey % 100), 'typescript', o_orderkey % 1000 + 1, o_orderstatus = 'F' FROM orders
), bound AS (
  SELECT l_orderkey, 'supplier:' || l_suppkey AS dst_id, 'calls' AS type, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS r FROM lineitem GROUP BY l_orderkey, l_suppkey
  UNION ALL SELECT l_orderkey, 'part:' || l_partkey, 'queries', min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) FROM lineitem GROUP BY l_orderkey, l_partkey
), edges AS (
  SELECT 'nation:' || n_nationkey AS src_id, 'region:' || n_regionkey AS dst_id, 'references' AS type, 'exact' AS confidence, 'nation' AS path, CAST(1 AS BIGINT) AS line FROM nation
  UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'defines', 'exact', 'region', 1 FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'references', 'exact', 'customer', c_custkey % 1000 + 1 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'references', 'exact', 'supplier', s_suppkey % 1000 + 1 FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'calls', 'exact', 'orders/' || (o_orderkey % 100), o_orderkey % 1000 + 1 FROM orders
  UNION ALL SELECT 'orders:' || l_orderkey, dst_id, type, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'resolved' ELSE 'heuristic' END, 'orders/' || (l_orderkey % 100), l_orderkey % 1000 + 1 FROM bound
), ranked_edges AS (
  SELECT *, CASE confidence WHEN 'exact' THEN 0 WHEN 'resolved' THEN 1 ELSE 2 END AS conf_rank FROM edges
)
"""
