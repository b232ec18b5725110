"""Queries over imports and the resolution ladder of the tree of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ladder
from ..sources import code
from ..tables import kept

QUERIES, ORACLES = {}, {}

#: Every rung in SQL, each with what it applies to.
_LADDER = (
    code.SQL
    + """
, owners AS (
  SELECT path, regexp_extract(qualified, '^(.*)[.][^.]*$', 1) AS owner, regexp_extract(qualified, '([^.]*)$', 1) AS name, min(id) AS id FROM syms WHERE contains(qualified, '.') GROUP BY 1, 2, 3
), types AS (
  SELECT id, path, name, qualified, pr, exported FROM syms WHERE kind IN ('class', 'struct', 'interface')
), ups AS (
  SELECT id AS holder, id AS base, 0 AS level FROM types UNION ALL SELECT owner, base, 1 FROM bases UNION ALL SELECT x.owner, y.base, 2 FROM bases x JOIN bases y ON y.owner = x.base
), member AS (
  SELECT holder, o.name, arg_min(o.id, (level, o.id)) AS id FROM ups JOIN types t ON t.id = ups.base JOIN owners o ON o.path = t.path AND o.owner = t.qualified GROUP BY holder, o.name
), bound AS (
  SELECT path, alias, arg_min(id, rid) AS id, arg_min(kind, rid) AS kind, arg_min(target_path, rid) AS target_path FROM placed WHERE alias IS NOT NULL GROUP BY path, alias
), named AS (
  SELECT *, coalesce(qualifier = 'self', false) AS selfish FROM refs WHERE type <> 'queries'
), fits AS (
  SELECT *, CASE WHEN type <> 'calls' OR selfish THEN 'any' WHEN qualifier IS NULL THEN 'bare' ELSE 'on' END AS shape FROM named
), sees AS (
  SELECT path, path AS seen FROM files UNION SELECT path, target_path FROM placed UNION SELECT path, file FROM placed WHERE via IS NOT NULL
  UNION SELECT x.path, y.path FROM files x JOIN files y ON y.b = x.b AND y.g // 2 = x.g // 2
), shapes AS (
  SELECT *, 'any' AS shape FROM syms UNION ALL SELECT *, 'bare' FROM syms WHERE kind <> 'method' UNION ALL SELECT *, 'on' FROM syms WHERE kind <> 'function'
), near AS (
  SELECT s.path, d.name, d.shape, count(*) AS n, list(d.id) AS ids FROM sees s JOIN shapes d ON d.path = s.seen GROUP BY 1, 2, 3
), far AS (
  SELECT name, shape, count(*) AS n, list(id) AS ids FROM shapes GROUP BY 1, 2
), units AS (
  SELECT b, g // 2 AS unit, name, arg_min(id, (pr, NOT exported, s.path, id)) AS id FROM syms s JOIN files USING (path) GROUP BY 1, 2, 3
), hits AS (
  SELECT rid, unnest(ids) AS id, 0 AS rung, CASE WHEN n = 1 THEN 'resolved' ELSE 'heuristic' END AS confidence FROM refs JOIN (SELECT name, count(*) AS n, list(id) AS ids FROM syms WHERE kind = 'table' GROUP BY name) t USING (name) WHERE type = 'queries' AND n <= 4
  UNION ALL SELECT rid, coalesce(d.id, m.id), 1, 'resolved' FROM named r
    LEFT JOIN (SELECT path, qualified, min(id) AS id FROM syms GROUP BY 1, 2) d ON d.path = r.path AND d.qualified = regexp_extract(src_qualified, '^(.*)[.][^.]*$', 1) || '.' || r.name
    LEFT JOIN (SELECT path, qualified, min(id) AS id FROM types GROUP BY 1, 2) t ON t.path = r.path AND t.qualified = regexp_extract(src_qualified, '^(.*)[.][^.]*$', 1)
    LEFT JOIN member m ON m.holder = t.id AND m.name = r.name WHERE selfish AND contains(src_qualified, '.') AND coalesce(d.id, m.id) IS NOT NULL
  UNION ALL SELECT rid, b.id, 2, CASE WHEN n = 1 THEN 'exact' ELSE 'resolved' END FROM named r JOIN best b USING (path, name) WHERE qualifier IS NULL OR selfish
  UNION ALL SELECT rid, coalesce(b.id, s.id), 3, 'resolved' FROM named r LEFT JOIN bound b ON b.path = r.path AND b.alias = r.name
    LEFT JOIN (SELECT p.path, x.name, arg_min(x.id, p.rid) AS id FROM placed p JOIN best x ON x.path = p.target_path WHERE alias IS NULL AND symbol IS NULL AND kind = 'module' GROUP BY 1, 2) s ON s.path = r.path AND s.name = r.name
    WHERE qualifier IS NULL AND coalesce(b.id, s.id) IS NOT NULL
  UNION ALL SELECT rid, coalesce(CASE WHEN b.kind = 'module' THEN x.id END, m.id), 4, 'resolved' FROM named r JOIN bound b ON b.path = r.path AND b.alias = split_part(r.qualifier, '.', 1)
    JOIN files f ON f.path = b.target_path LEFT JOIN units x ON x.b = f.b AND x.unit = f.g // 2 AND x.name = r.name LEFT JOIN member m ON m.holder = b.id AND m.name = r.name
    WHERE NOT selfish AND coalesce(CASE WHEN b.kind = 'module' THEN x.id END, m.id) IS NOT NULL
  UNION ALL SELECT rid, m.id, 5, 'resolved' FROM named r JOIN (SELECT path, name, arg_min(id, (pr, NOT exported, path, id)) AS id FROM types GROUP BY 1, 2) t ON t.path = r.path AND t.name = split_part(r.qualifier, '.', 1)
    JOIN member m ON m.holder = t.id AND m.name = r.name WHERE NOT selfish
  UNION ALL SELECT rid, ids[1], 6, 'resolved' FROM fits JOIN near USING (path, name, shape) WHERE n = 1
  UNION ALL SELECT rid, unnest(ids), 7, 'heuristic' FROM fits JOIN near USING (path, name, shape) WHERE n BETWEEN 2 AND 4 AND qualifier IS NOT NULL AND NOT selfish
  UNION ALL SELECT rid, unnest(ids), 8, 'heuristic' FROM fits JOIN far USING (name, shape) WHERE n <= 4 AND (qualifier IS NULL OR selfish)
  UNION ALL SELECT rid, u.id, 9, 'heuristic' FROM fits f JOIN (SELECT s_name AS name, min('supplier:' || s_suppkey) AS id FROM supplier WHERE s_acctbal > 0 GROUP BY s_name HAVING count(*) = 1) u USING (name)
    WHERE (qualifier IS NULL OR selfish) AND NOT EXISTS (SELECT 1 FROM far x WHERE x.name = f.name AND x.shape = f.shape)
), answer AS (
  SELECT DISTINCT rid, id, ['tables', 'self', 'same_file', 'imported', 'receiver', 'local_type', 'visible', 'qualified', 'global', 'linked'][rung + 1] AS rung, confidence
  FROM (SELECT *, min(rung) OVER (PARTITION BY rid) AS least FROM hits) WHERE rung = least
)
"""
)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.place_imports(kept(code.imports(spark, sf_dir), "imports"), code.modules(spark, sf_dir), kept(code.nodes(spark, sf_dir), "nodes"))


@query(code.SQL + "SELECT rid, path, alias, symbol, id, kind, via FROM placed")
def imports_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each import binds: symbols, through what a file passes on; defaults; modules; modules below a package."""
    return _placed(spark, sf_dir).select("rid", "path", "alias", "symbol", "id", "kind", "via")


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, refs = kept(code.nodes(spark, sf_dir), "nodes"), kept(code.refs(spark, sf_dir), "refs")
    placed = kept(_placed(spark, sf_dir), "placed")
    return ladder.resolve(refs, nodes, placed, code.bases(spark, sf_dir), code.linked(spark, sf_dir), packages=code.packages(spark, sf_dir)), refs


@query(_LADDER + "SELECT rid, id, rung, confidence FROM answer")
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references through all rungs."""
    return _resolved(spark, sf_dir)[0]


@query(_LADDER + "SELECT r.type, coalesce(a.rung, 'none') AS rung, count(DISTINCT r.rid) AS refs, count(a.id) AS targets FROM refs r LEFT JOIN answer a USING (rid) GROUP BY 1, 2")
def refs_by_rung(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references each rung settles, and how many stay open."""
    resolved, refs = _resolved(spark, sf_dir)
    all_ = refs.select("rid", "type").join(resolved, "rid", "left").withColumn("rung", F.coalesce("rung", F.lit("none")))
    return all_.groupBy("type", "rung").agg(F.count_distinct("rid").alias("refs"), F.count("id").alias("targets"))


@query(_LADDER + "SELECT DISTINCT src_id, id AS dst_id, type, confidence, rid FROM answer JOIN refs USING (rid) WHERE src_id <> id")
def edges_from_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relationships that resolved references make; those that mean themselves make none."""
    resolved, refs = _resolved(spark, sf_dir)
    return ladder.edges_of(resolved, refs)


_SWIFT = """
WITH c AS (
  SELECT c_custkey AS k, c_nationkey AS n, 'c' || c_custkey AS name, 'Sources/M' || (c_nationkey % 5) || '/E' || (c_custkey % 3) || 'x' || c_nationkey || '.swift' AS path FROM customer
), types AS (
  SELECT n_nationkey AS n, 'T' || n_nationkey AS name, 'Sources/M' || (n_nationkey % 5) || '/T' || n_nationkey || '.swift' AS path FROM nation
), tops AS (
  SELECT s_suppkey AS k, s_nationkey % 5 AS m, 'f' || s_suppkey AS name, 'Sources/M' || (s_nationkey % 5) || '/F' || s_suppkey || '.swift' AS path FROM supplier
), least AS (SELECT n, min(k) AS k FROM c GROUP BY n)
SELECT k * 10 AS rid, 'T' || n || '.' || name AS target, 'self' AS rung, 'resolved' AS confidence FROM c
UNION ALL SELECT c.k * 10 + 1, 'T' || l.n || '.c' || l.k, 'swift_member', 'resolved' FROM c JOIN least l ON l.n = (c.n + 5) % 25
UNION ALL SELECT c.k * 10 + 3, t.name, CASE WHEN t.m = c.n % 5 THEN 'visible' ELSE 'global' END, CASE WHEN t.m = c.n % 5 THEN 'resolved' ELSE 'heuristic' END FROM c JOIN tops t ON t.k = c.k % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier)
UNION ALL SELECT c.k * 10 + 4, 'T' || l.n || '.c' || l.k, CASE WHEN c.k % 3 = l.k % 3 THEN 'same_file' ELSE 'swift_member' END, CASE WHEN c.k % 3 = l.k % 3 THEN 'exact' ELSE 'resolved' END FROM c JOIN least l ON l.n = c.n
UNION ALL SELECT t.n * 10 - 10000, 'T' || ((t.n + 1) % 25) || '.c' || l.k, 'swift_member', 'resolved' FROM types t JOIN least l ON l.n = (t.n + 1) % 25
"""


@query(_SWIFT)
def resolve_swift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types over several files of a module: members through self, receivers, the type around and bases; names of other modules' types."""
    text_ = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    k, n = F.col("k"), F.col("n")
    customer = code.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    nation = code.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    supplier = code.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))

    def node(rows: DataFrame, file, name, qualified, kind: str) -> DataFrame:
        path = text_("Sources/M", n % 5, "/", file, ".swift")
        return rows.select(text_(path, ":", qualified).alias("id"), path.alias("path"), name.alias("name"), qualified.alias("qualified"), F.lit(kind).alias("kind"), F.lit(True).alias("exported"), F.lit("swift").alias("lang"))

    in_file, method, type_ = text_("E", k % 3, "x", n), text_("c", k), text_("T", n)
    nodes = node(customer, in_file, method, text_(type_, ".", method), "method").unionByName(node(nation, type_, type_, type_, "struct")).unionByName(node(supplier, text_("F", k), text_("f", k), text_("f", k), "function"))
    nodes = kept(nodes, "nodes")
    packages = nodes.select("path", F.split("path", "/")[1].alias("package"), F.lit(True).alias("shared"), F.lit(True).alias("wide")).distinct()
    bases = nation.select(text_("Sources/M", n % 5, "/", type_, ".swift:", type_).alias("owner"), text_("Sources/M", (n + 1) % 25 % 5, "/T", (n + 1) % 25, ".swift:T", (n + 1) % 25).alias("base"))

    least = customer.groupBy("n").agg(F.min("k").alias("least"))
    own = customer.join(least, "n").join(least.select(((n + 20) % 25).alias("n"), F.col("least").alias("far")), "n", "left").join(least.select(((n + 24) % 25).alias("n"), F.col("least").alias("next")), "n", "left")
    few = supplier.agg(F.count("*").alias("size"), F.min("k").alias("start"))  # one row
    own = own.join(F.broadcast(few))
    src, path = text_("Sources/M", n % 5, "/", in_file, ".swift:", type_, ".", method), text_("Sources/M", n % 5, "/", in_file, ".swift")
    ref = lambda at, name, qualifier: F.struct((k * 10 + at).alias("rid"), name.alias("name"), qualifier.alias("qualifier"))
    none = F.lit(None).cast("string")
    each = F.array(
        ref(0, method, F.lit("self")), ref(1, text_("c", F.col("far")), text_("T", (n + 5) % 25)), ref(2, text_("c", F.col("next")), text_("T", (n + 1) % 25)),
        ref(3, text_("f", k % F.col("size") + F.col("start")), none), ref(4, text_("c", F.col("least")), none),
    )
    refs = own.select(src.alias("src_id"), path.alias("path"), F.explode(each).alias("r")).select("src_id", "path", "r.*")
    # from a type's own file, what its base has: the base is of another module
    at = text_("Sources/M", n % 5, "/", type_, ".swift")
    above = nation.join(least.select(((n + 24) % 25).alias("n"), F.col("least").alias("next")), "n").select(text_(at, ":", type_).alias("src_id"), at.alias("path"), (n * 10 - 10000).alias("rid"), text_("c", F.col("next")).alias("name"), F.lit("super").alias("qualifier"))
    refs = refs.unionByName(above).filter("name IS NOT NULL").withColumn("type", F.lit("calls"))
    placed = spark.createDataFrame([], "rid bigint, path string, alias string, symbol string, id string, kind string, target_path string, via string, via_path string")
    # members of a type's base are those in its own file, so the bases' files get a declaration of each first member
    extra = nation.join(least, "n").select(text_(at, ":", type_, ".c", F.col("least")).alias("id"), at.alias("path"), text_("c", F.col("least")).alias("name"), text_(type_, ".c", F.col("least")).alias("qualified"), F.lit("method").alias("kind"), F.lit(False).alias("exported"), F.lit("swift").alias("lang"))
    nodes = kept(nodes.unionByName(extra), "nodes-and-declarations")
    found = ladder.resolve(refs, nodes, placed, bases, packages=packages)
    return found.join(nodes.select("id", "qualified"), "id").select("rid", F.col("qualified").alias("target"), "rung", "confidence")
