"""Queries over the graph of the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, rank, resolve, store
from ..schemas import CALL_TYPES, CONFIDENCES, IMPACT_TYPES, KIND_ORDER, rank_in
from ..sources import star
from ..tables import kept

QUERIES, ORACLES = {}, {}


def query(sql: str | None, graph_sql: bool = True):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (star.SQL if graph_sql else "") + sql
        return f

    return add


def _edges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None, at: tuple[str, ...] | None = None) -> DataFrame:
    """The relationships that a query follows, written for it, so that its levels don't join tables again."""
    rows = star.edges(spark, sf_dir, at=at).select("src_id", "dst_id", "confidence", "path", "line", "type")
    return kept(rows if types is None else rows.filter(F.col("type").isin(*types)), "edges")


def _root(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "root string, id string")


def _in(types) -> str:
    return ", ".join(f"'{t}'" for t in types)


_IMPACT = f"""
, reach AS (
  SELECT CAST('nation:3' AS VARCHAR) AS id, CAST(0 AS BIGINT) AS d
  UNION SELECT e.src_id, d + 1 FROM reach JOIN edges e ON e.dst_id = reach.id WHERE d < 3 AND e.type IN ({_in(IMPACT_TYPES)})
), nearest AS (SELECT id, min(d) AS d FROM reach GROUP BY id)
"""


@query(_IMPACT + "SELECT id, d AS distance, name, kind, path FROM nearest JOIN nodes USING (id) WHERE d > 0")
def impact_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that one nation's change may reach, three steps inbound."""
    reached = graph.traverse(_edges(spark, sf_dir, IMPACT_TYPES), _root(spark, "nation:3"), 3, "in", IMPACT_TYPES)
    near = reached.select("id", F.col("distance").cast("bigint").alias("distance"))
    return near.join(star.nodes(spark, sf_dir), "id").select("id", "distance", "name", "kind", "path")


@query(_IMPACT + "SELECT d AS distance, count(*) AS symbols, count(DISTINCT path) AS files, count(*) FILTER (WHERE exported) AS exported FROM nearest JOIN nodes USING (id) WHERE d > 0 GROUP BY d")
def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected symbols and files by distance."""
    reached = graph.traverse(_edges(spark, sf_dir, IMPACT_TYPES), _root(spark, "nation:3"), 3, "in", IMPACT_TYPES)
    joined = reached.select("id", F.col("distance").cast("bigint").alias("distance")).join(star.nodes(spark, sf_dir), "id")
    return joined.groupBy("distance").agg(
        F.count("*").alias("symbols"), F.count_distinct("path").alias("files"), F.count_if("exported").alias("exported")
    )


@query(f"SELECT DISTINCT src_id AS id FROM edges WHERE dst_id = 'supplier:1' AND type IN ({_in(CALL_TYPES)})")
def callers_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traverse(star.edges(spark, sf_dir), _root(spark, "supplier:1"), 1, "in", CALL_TYPES).select("id")


@query(
    f"""
, reach AS (
  SELECT CAST('orders:1' AS VARCHAR) AS id, CAST(0 AS BIGINT) AS d
  UNION SELECT e.dst_id, d + 1 FROM reach JOIN edges e ON e.src_id = reach.id WHERE d < 3 AND e.type IN ({_in(CALL_TYPES)})
)
SELECT id, min(d) AS distance FROM reach GROUP BY id HAVING min(d) > 0
"""
)
def callees_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.traverse(_edges(spark, sf_dir, CALL_TYPES), _root(spark, "orders:1"), 3, "out", CALL_TYPES)
    return found.select("id", F.col("distance").cast("bigint").alias("distance"))


@query(
    f"""
, reach AS (
  SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS id, CAST(0 AS BIGINT) AS d FROM region
  UNION SELECT root, e.src_id, d + 1 FROM reach JOIN edges e ON e.dst_id = reach.id WHERE d < 2 AND e.type IN ({_in(IMPACT_TYPES)})
), nearest AS (SELECT root, id, min(d) AS d FROM reach GROUP BY root, id)
SELECT root, d AS distance, count(*) AS n FROM nearest WHERE d > 0 GROUP BY root, d
"""
)
def bulk_impact_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One traversal for all regions at once."""
    roots = star.nodes(spark, sf_dir).filter("id LIKE 'region:%'").select(F.col("id").alias("root"), "id")
    found = graph.traverse(_edges(spark, sf_dir, IMPACT_TYPES), roots, 2, "in", IMPACT_TYPES)
    return found.groupBy("root", F.col("distance").cast("bigint").alias("distance")).agg(F.count("*").alias("n"))


@query(
    """
, ways AS (SELECT src_id AS a, dst_id AS b FROM edges UNION SELECT dst_id, src_id FROM edges)
, reach AS (
  SELECT CAST('customer:1' AS VARCHAR) AS id, CAST(0 AS BIGINT) AS d
  UNION SELECT b, d + 1 FROM reach JOIN ways ON a = id WHERE d < 4
)
SELECT 'customer:1' AS a, id AS b, min(d) AS length FROM reach WHERE id IN ('supplier:1', 'part:1', 'nation:3', 'region:0', 'customer:1') GROUP BY id
"""
)
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = ["supplier:1", "part:1", "nation:3", "region:0", "customer:1"]
    pairs = spark.createDataFrame([("customer:1", b) for b in ends], "a string, b string")
    found = graph.shortest_paths(_edges(spark, sf_dir), pairs, 4)
    return found.select("a", "b", F.col("length").cast("bigint").alias("length"))


@query(
    """
SELECT 'nation:' || s_nationkey AS a, 'region:' || n_regionkey AS b, CAST(1 AS BIGINT) AS length, true AS whole, true AS known FROM nation JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = n_nationkey
UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey, 2, true, true FROM supplier JOIN nation ON n_nationkey = s_nationkey
"""
)
def shortest_path_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each supplier and its nation to their region: hops join up from end to end, and each is a relationship."""
    nation = star.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("b"))
    supplier = star.table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows by definition
    pairs = supplier.select(F.explode(F.array(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")))).alias("a"), "b").distinct()
    edges = _edges(spark, sf_dir)
    found = kept(graph.shortest_paths(edges, pairs, 4), "paths")
    walk = F.aggregate("hops", F.col("a"), lambda at, h: F.when(h["src_id"] == at, h["dst_id"]).when(h["dst_id"] == at, h["src_id"]).otherwise("nowhere"))
    hops = found.select("a", "b", F.explode("hops").alias("h")).select("a", "b", "h.*").distinct()
    ends = ["src_id", "dst_id", "type"]
    there = graph.only(edges.select(*ends), kept(hops.select(*ends).distinct(), "hops"), ends).distinct()
    known = hops.join(there, ends, "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"))
    return found.join(known, ["a", "b"]).select("a", "b", F.col("length").cast("bigint").alias("length"), (walk == F.col("b")).alias("whole"), (F.col("n") == F.col("length")).alias("known"))


@query(
    """
SELECT dst_id AS id, count(*) AS degree FROM edges WHERE type <> 'defines' GROUP BY dst_id
"""
)
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_degree(star.edges(spark, sf_dir))


@query(
    """
SELECT n.id, n.path, degree FROM (SELECT dst_id AS id, count(*) AS degree FROM edges WHERE type <> 'defines' GROUP BY dst_id) d
JOIN nodes n USING (id) ORDER BY degree DESC, path, id LIMIT 12
"""
)
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve symbols with the most inbound edges (a top-k report)."""
    ranked = graph.in_degree(star.edges(spark, sf_dir)).join(star.nodes(spark, sf_dir), "id")
    return ranked.select("id", "path", "degree").orderBy(F.col("degree").desc(), "path", "id").limit(12)


@query(
    """
SELECT n.id, n.path, n.name FROM nodes n WHERE n.exported AND n.kind IN ('function', 'constant', 'class')
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst_id = n.id AND e.type <> 'defines')
"""
)
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported symbols that nothing points at."""
    used = star.edges(spark, sf_dir).filter("type <> 'defines'").select(F.col("dst_id").alias("id"))
    own = star.nodes(spark, sf_dir).filter(F.col("exported") & F.col("kind").isin("function", "constant", "class"))
    return own.join(used, "id", "left_anti").select("id", "path", "name")


@query("SELECT n.kind, count(*) AS symbols, count(*) FILTER (WHERE d.degree IS NULL) AS unused, CAST(coalesce(sum(degree), 0) AS BIGINT) AS inbound FROM nodes n LEFT JOIN (SELECT dst_id AS id, count(*) AS degree FROM edges WHERE type <> 'defines' GROUP BY dst_id) d USING (id) GROUP BY n.kind")
def degree_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of all symbols, those without an edge included."""
    all_ = star.nodes(spark, sf_dir).select("id", "kind").join(graph.in_degree(star.edges(spark, sf_dir)), "id", "left")
    return all_.groupBy("kind").agg(
        F.count("*").alias("symbols"), F.count_if(F.col("degree").isNull()).alias("unused"), F.coalesce(F.sum("degree"), F.lit(0)).alias("inbound")
    )


@query("SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.nodes(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT type, confidence, count(*) AS n FROM edges GROUP BY type, confidence")
def edge_type_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.edges(spark, sf_dir).groupBy("type", "confidence").agg(F.count("*").alias("n"))


@query("SELECT type, confidence, count(*) AS n FROM edges GROUP BY GROUPING SETS ((type), (confidence))")
def type_or_confidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = star.edges(spark, sf_dir)
    type_, confidence = F.col("type"), F.col("confidence")
    return edges.groupingSets([[type_], [confidence]], type_, confidence).agg(F.count("*").alias("n")).select("type", "confidence", "n")


@query("SELECT type, count(*) FILTER (WHERE confidence = 'exact') AS exact, count(*) FILTER (WHERE confidence = 'resolved') AS resolved, count(*) FILTER (WHERE confidence = 'heuristic') AS heuristic FROM edges GROUP BY type")
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCES]
    return star.edges(spark, sf_dir).groupBy("type").agg(*counts)


@query("SELECT (SELECT count(*) FROM nodes) AS symbols, (SELECT count(*) FROM edges) AS relationships, (SELECT count(DISTINCT path) FROM nodes) AS files, (SELECT count(*) FROM edges WHERE confidence = 'heuristic') AS uncertain")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star.nodes(spark, sf_dir).agg(F.count("*").alias("symbols"), F.count_distinct("path").alias("files"))
    edges = star.edges(spark, sf_dir).agg(F.count("*").alias("relationships"), F.count_if(F.col("confidence") == "heuristic").alias("uncertain"))
    return nodes.join(F.broadcast(edges)).select("symbols", "relationships", "files", "uncertain")  # a row each


@query("SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(DISTINCT path) AS files, count(*) AS symbols FROM nodes GROUP BY 1")
def dir_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    dir_ = F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")
    return star.nodes(spark, sf_dir).groupBy(dir_).agg(F.count_distinct("path").alias("files"), F.count("*").alias("symbols"))


@query("SELECT id, path, kind FROM nodes WHERE path = 'ASIA' OR starts_with(path, 'ASIA/')")
def path_prefix_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols in a file or below a directory; the name is taken literally."""
    return star.nodes(spark, sf_dir).filter((F.col("path") == "ASIA") | F.col("path").startswith("ASIA/")).select("id", "path", "kind")


@query("SELECT path, kind, count(*) AS n, min(line_start) AS first_line, max(line_start) AS last_line FROM nodes GROUP BY path, kind")
def outline_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.nodes(spark, sf_dir).groupBy("path", "kind").agg(
        F.count("*").alias("n"), F.min("line_start").alias("first_line"), F.max("line_start").alias("last_line")
    )


@query(
    """
SELECT dst_id AS id, src_id AS via_src, type AS via_type, confidence AS via_confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY dst_id ORDER BY conf_rank, path, line, dst_id, src_id, type) AS k FROM ranked_edges WHERE type <> 'defines'
) WHERE k = 1
"""
)
def via_edge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all edges to a symbol, the one by which a traversal reaches it."""
    ranked = graph.with_rank(star.edges(spark, sf_dir).filter("type <> 'defines'"))
    first = ranked.groupBy(F.col("dst_id").alias("id")).agg(F.min(F.struct(*graph.EDGE_ORDER, "confidence")).alias("v"))
    return first.select("id", F.col("v.src_id").alias("via_src"), F.col("v.type").alias("via_type"), F.col("v.confidence").alias("via_confidence"))


_NEAR = """
, asked AS (SELECT id FROM nodes WHERE kind = 'struct')
, sides AS (
  SELECT id, 'out' AS direction, dst_id AS other, type, conf_rank, e.path, line, confidence FROM asked JOIN ranked_edges e ON src_id = id
  UNION ALL SELECT id, 'in', src_id, type, conf_rank, e.path, line, confidence FROM asked JOIN ranked_edges e ON dst_id = id
), dedup AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, direction, other, type ORDER BY conf_rank, path, line, confidence) AS k FROM sides) WHERE k = 1
)
"""


@query(_NEAR + "SELECT id, direction, other, type, confidence FROM dedup")
def neighbours_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = star.nodes(spark, sf_dir).filter("kind = 'struct'").select("id")
    found = graph.neighbours(_edges(spark, sf_dir, at=("struct",)), asked)
    return found.select("id", "direction", "other", "type", F.col("via.confidence").alias("confidence"))


@query(
    _NEAR
    + """SELECT id, direction, type, other, r AS rank, n AS in_group FROM (
  SELECT *, row_number() OVER (PARTITION BY id, direction, type ORDER BY conf_rank, path, line, other) AS r, count(*) OVER (PARTITION BY id, direction, type) AS n FROM dedup
) WHERE r <= 12"""
)
def neighbours_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dozen neighbours of each kind, best evidence first, and how many there are."""
    asked = star.nodes(spark, sf_dir).filter("kind = 'struct'").select("id")
    edges = _edges(spark, sf_dir, at=("struct",))
    found, most = graph.neighbours(edges, asked), graph.most_neighbours(edges, asked)
    order = ["via.conf_rank", "via.path", "via.line", "other"]
    capped = rank.first_per_group(found, ["id", "direction", "type"], order, 12, rank.parts_of(most))
    return capped.select("id", "direction", "type", "other", F.col("rank").cast("bigint").alias("rank"), F.col("in_group").cast("bigint").alias("in_group"))


@query(
    """
, lines AS (
  SELECT path, line_start, id, kind || ' ' || qualified || ' ' || path || ':' || line_start AS line FROM nodes
), spent AS (
  SELECT path, id, line, sum(CAST(ceil(length(line) / 4.0) AS BIGINT) + 1) OVER (PARTITION BY path ORDER BY line_start, id ROWS UNBOUNDED PRECEDING) AS s FROM lines
)
SELECT path, id, line, CAST(s AS BIGINT) AS spent FROM spent WHERE s <= 400 - 40
"""
)
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file, the listing that fits in 400 tokens."""
    line = F.concat("kind", F.lit(" "), "qualified", F.lit(" "), "path", F.lit(":"), F.col("line_start").cast("string"))
    lines = star.nodes(spark, sf_dir).select("path", "line_start", "id", line.alias("line"))
    return rank.within_budget(lines, 400, ["path"], ["line_start", "id"]).select("path", "id", "line", "spent")


_GATE = """
, cands AS (SELECT name, split_part(qualified, '.', 1) AS scope, count(*) AS n FROM nodes WHERE kind = 'constant' GROUP BY 1, 2)
"""


@query(_GATE + "SELECT name, scope, n, CASE WHEN n = 1 THEN 'resolved' WHEN n <= 4 THEN 'heuristic' END AS verdict FROM cands")
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = star.nodes(spark, sf_dir).filter("kind = 'constant'").withColumn("scope", F.split("qualified", "[.]")[0])
    counted = parts.groupBy("name", "scope").agg(F.count("*").alias("n"))
    return counted.withColumn("verdict", resolve.gate(F.col("n")))


@query(
    """
SELECT path, first(id ORDER BY pr, NOT exported, id) AS id FROM (
  SELECT *, CASE kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 WHEN 'class' THEN 2 WHEN 'struct' THEN 3 WHEN 'interface' THEN 4 WHEN 'constant' THEN 5 WHEN 'table' THEN 6 WHEN 'endpoint' THEN 7 ELSE 8 END AS pr FROM nodes
) GROUP BY path
"""
)
def prefer_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred definition of each file."""
    return resolve.prefer(star.nodes(spark, sf_dir), ["path"])


@query(
    """
, defs AS (SELECT id, name, path, kind, exported, split_part(qualified, '.', 1) AS scope FROM nodes WHERE kind = 'constant')
, refs AS (
  SELECT p_partkey * 2 AS rid, p_name AS name, p_brand AS scope, 'part/' || (p_partkey * 7 % 10) AS path, CAST(NULL AS VARCHAR) AS qualifier FROM part
  UNION ALL SELECT p_partkey * 2 + 1, p_name, 'Brand#' || (p_partkey % 60), 'other', 'x' FROM part
), here AS (
  SELECT path, name, count(*) AS n, first(id ORDER BY NOT exported, path, id) AS id FROM defs GROUP BY path, name
), r1 AS (
  SELECT rid, h.id, CASE WHEN n = 1 THEN 'exact' ELSE 'resolved' END AS confidence FROM refs r JOIN here h ON r.path = h.path AND r.name = h.name WHERE qualifier IS NULL
), left_ AS (SELECT * FROM refs WHERE rid NOT IN (SELECT rid FROM r1))
, near AS (SELECT scope, name, count(*) AS n, min(id) AS only_ FROM defs GROUP BY scope, name)
, r2 AS (SELECT rid, only_ AS id, 'resolved' AS confidence FROM left_ JOIN near USING (scope, name) WHERE n = 1)
, r3 AS (
  SELECT rid, d.id, 'heuristic' AS confidence FROM left_ l JOIN near USING (scope, name) JOIN defs d ON d.scope = l.scope AND d.name = l.name
  WHERE n BETWEEN 2 AND 4 AND qualifier IS NOT NULL
), far AS (SELECT name FROM defs GROUP BY name HAVING count(*) <= 4)
, r4 AS (
  SELECT rid, d.id, 'heuristic' AS confidence FROM left_ l JOIN far USING (name) JOIN defs d ON d.name = l.name
  WHERE qualifier IS NULL AND rid NOT IN (SELECT rid FROM r2)
)
SELECT CAST(rid AS BIGINT) AS rid, id, confidence FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)
"""
)
def resolve_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two refs to each part's name, a bare and a qualified one, through the ladder."""
    part = star.table(spark, sf_dir, "part")
    definitions = star.nodes(spark, sf_dir).filter("kind = 'constant'").withColumn("scope", F.split("qualified", "[.]")[0])
    bare = part.select(
        (F.col("p_partkey") * 2).alias("rid"), F.col("p_name").alias("name"), F.col("p_brand").alias("scope"),
        F.concat(F.lit("part/"), (F.col("p_partkey") * 7 % 10).cast("string")).alias("path"), F.lit(None).cast("string").alias("qualifier"),
    )
    dotted = part.select(
        (F.col("p_partkey") * 2 + 1).alias("rid"), F.col("p_name").alias("name"), F.concat(F.lit("Brand#"), (F.col("p_partkey") % 60).cast("string")).alias("scope"),
        F.lit("other").alias("path"), F.lit("x").alias("qualifier"),
    )
    return resolve.resolve_names(bare.unionByName(dotted), definitions)


@query(
    """
SELECT src_id, dst_id, type, confidence, line FROM (
  SELECT *, row_number() OVER (PARTITION BY src_id, dst_id, type ORDER BY line DESC, confidence DESC) AS k FROM (
    SELECT 'orders:' || l_orderkey AS src_id, 'part:' || l_partkey AS dst_id, 'queries' AS type,
           CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'resolved' ELSE 'heuristic' END AS confidence, CAST(l_linenumber AS BIGINT) AS line FROM lineitem
  )
) WHERE k = 1
""",
    graph_sql=False,
)
def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written in order of their number; the last writer of an edge wins."""
    flag = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "resolved").otherwise("heuristic")
    rows = star.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("src_id"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst_id"),
        F.lit("queries").alias("type"), flag.alias("confidence"), F.col("l_linenumber").cast("bigint").alias("line"),
    )
    return store.upsert(rows, ["src_id", "dst_id", "type"], [F.col("line"), F.col("confidence")])


@query(
    """
SELECT l_orderkey AS path, l_linenumber AS base, CAST(k AS BIGINT) AS ordinal, CASE WHEN k = 1 THEN l_orderkey || ':' || l_linenumber ELSE l_orderkey || ':' || l_linenumber || '#' || k END AS id FROM (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem
)
""",
    graph_sql=False,
)
def ordinal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of line items; equal ones get #2, #3, ..."""
    rows = star.table(spark, sf_dir, "lineitem").withColumn(
        "name", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    )
    done = store.numbered_ids(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"], "name")
    return done.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("bigint").alias("base"), "ordinal", "id")


@query("SELECT id FROM nodes WHERE kind <> 'constant' OR id IN (SELECT dst_id FROM edges)")
def orphan_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts taken as external symbols: those that no order names go."""
    nodes = star.nodes(spark, sf_dir).withColumn("external", F.col("kind") == "constant")
    return store.without_orphans(nodes, star.edges(spark, sf_dir)).select("id")


@query(
    """
SELECT id, kind, CAST(row_number() OVER (ORDER BY exported DESC, CASE kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 WHEN 'class' THEN 2 WHEN 'struct' THEN 3 WHEN 'interface' THEN 4 WHEN 'endpoint' THEN 5 WHEN 'table' THEN 6 WHEN 'constant' THEN 7 ELSE 8 END, path, line_start, id) AS BIGINT) AS place
FROM nodes QUALIFY place <= 25
"""
)
def search_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 symbols in the order of search results (a top-k report)."""
    from pyspark.sql.window import Window

    order = [F.col("exported").desc(), rank_in(KIND_ORDER, "kind"), F.col("path"), F.col("line_start"), F.col("id")]
    top = star.nodes(spark, sf_dir).orderBy(*order).limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("id", "kind", "place")


@query(
    """
SELECT p.id, f.degree FROM (SELECT src_id AS id, count(*) AS degree FROM edges GROUP BY src_id) f JOIN nodes p USING (id) WHERE kind = 'function' ORDER BY degree DESC, id LIMIT 1
"""
)
def example_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function with the most relationships (a top-1 report)."""
    degree = star.edges(spark, sf_dir).groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("degree"))
    found = degree.join(star.nodes(spark, sf_dir).filter("kind = 'function'"), "id")
    return found.select("id", "degree").orderBy(F.col("degree").desc(), "id").limit(1)


@query(
    """
, mine AS (SELECT e.*, regexp_extract(n.path, '^[^/]*', 0) AS repo FROM edges e JOIN nodes n ON n.id = e.src_id WHERE e.type = 'references')
SELECT t.id, repo, src_id AS caller, e.path, e.line FROM mine e JOIN nodes t ON t.id = e.dst_id WHERE t.kind = 'module' AND repo <> 'ASIA'
"""
)
def foreign_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as linked repositories: who refers to a module from any repository but one."""
    nodes = kept(star.nodes(spark, sf_dir), "nodes")
    repo = nodes.select(F.col("id").alias("src_id"), F.regexp_extract("path", "^[^/]*", 0).alias("repo"))
    targets = nodes.filter("kind = 'module'").select(F.col("id"))
    edges = star.edges(spark, sf_dir).filter("type = 'references'").join(repo.filter("repo <> 'ASIA'"), "src_id")
    return edges.join(targets, edges["dst_id"] == targets["id"]).select("id", "repo", F.col("src_id").alias("caller"), "path", "line")


@query(
    f"""
, changed AS (SELECT DISTINCT path FROM nodes WHERE kind = 'struct' AND path LIKE 'A%')
, reach AS (
  SELECT n.path AS root, n.id, CAST(0 AS BIGINT) AS d FROM nodes n JOIN changed USING (path) WHERE n.kind <> 'module'
  UNION SELECT root, e.src_id, d + 1 FROM reach JOIN edges e ON e.dst_id = reach.id WHERE d < 2 AND e.type IN ({_in(IMPACT_TYPES)})
), nearest AS (SELECT root, id, min(d) AS d FROM reach GROUP BY root, id)
SELECT root, count(*) AS affected, count(DISTINCT n.path) AS files FROM nearest JOIN nodes n USING (id) WHERE d > 0 AND n.path <> root GROUP BY root
"""
)
def changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each changed file, what depends on its symbols outside of it: one traversal for all files."""
    nodes = kept(star.nodes(spark, sf_dir), "nodes")
    changed = nodes.filter("kind = 'struct' AND path LIKE 'A%'").select("path").distinct()
    roots = nodes.filter("kind <> 'module'").join(changed, "path").select(F.col("path").alias("root"), "id")
    ends = kept(star.edges(spark, sf_dir).filter(F.col("type").isin(*IMPACT_TYPES)).select("src_id", "dst_id", "type"), "ends")
    found = graph.traverse(ends, roots, 2, "in", IMPACT_TYPES, evidence=False).select("root", "id")
    outside = found.join(nodes.select("id", "path"), "id").filter("path <> root")
    return outside.groupBy("root").agg(F.count("*").alias("affected"), F.count_distinct("path").alias("files"))
