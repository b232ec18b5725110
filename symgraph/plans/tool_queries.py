"""Queries of the question tools, of names and modules as columns, and of table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.lines import tables_in_text
from ..functions import modules, text
from ..operators import resolve, store, tools
from ..schemas import CALL_TYPES, IMPACT_TYPES
from ..sources import code, star
from ..tables import kept

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# answers

_TYPES = ", ".join(f"'{t}'" for t in IMPACT_TYPES)
_REACHED = (
    star.SQL
    + f"""
, reach AS (
  SELECT CAST('nation:3' AS VARCHAR) AS id, CAST(0 AS BIGINT) AS d
  UNION SELECT e.src_id, d + 1 FROM reach JOIN edges e ON e.dst_id = reach.id WHERE d < 2 AND e.type IN ({_TYPES})
), nearest AS (SELECT id, min(d) AS d FROM reach GROUP BY id)
, reached AS (
  SELECT n.id, n.d, s.path, arg_min(e.confidence, (e.conf_rank, e.path, e.line, e.dst_id, e.src_id, e.type)) AS confidence
  FROM nearest n JOIN nodes s USING (id) JOIN ranked_edges e ON e.src_id = n.id AND e.type IN ({_TYPES}) JOIN nearest p ON p.id = e.dst_id AND p.d = n.d - 1 WHERE n.d > 0 GROUP BY n.id, n.d, s.path
)
"""
)


def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("nation:3", "nation:3")], "root string, id string")
    return tools.impact_of(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), roots, 2, None)


@query(_REACHED + "SELECT path, min(d) AS best, count(*) AS items FROM reached GROUP BY path ORDER BY best, path LIMIT 20")
def impact_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest files of an impact (a top-k report)."""
    return tools.by_file(_impact(spark, sf_dir), 20).select("path", F.col("best").cast("bigint").alias("best"), "items")


@query(_REACHED + "SELECT count(*) AS symbols, count(DISTINCT path) AS files, count(*) FILTER (WHERE d = 1) AS direct, count(*) FILTER (WHERE confidence = 'heuristic') AS heuristic FROM reached")
def impact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.impact_numbers(_impact(spark, sf_dir))


@query(
    star.SQL
    + """
, mine AS (SELECT e.*, regexp_extract(n.path, '^[^/]*', 0) AS repo FROM edges e JOIN nodes n ON n.id = e.src_id), hits AS (
  SELECT repo, src_id AS caller, path, line, dst_id, row_number() OVER (PARTITION BY repo ORDER BY path, line, src_id, dst_id) AS rank, count(*) OVER (PARTITION BY repo) AS in_group
  FROM mine WHERE repo <> 'ASIA' AND dst_id IN (SELECT id FROM nodes WHERE kind IN ('module', 'class'))
)
SELECT repo, caller, path, line, dst_id, CAST(rank AS BIGINT) AS rank, CAST(in_group AS BIGINT) AS in_group FROM hits WHERE rank <= 10
"""
)
def foreign_callers_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First folders as repositories: ten callers from each, and how many there are."""
    nodes = kept(star.nodes(spark, sf_dir), "nodes")
    repo = nodes.select(F.col("id").alias("src_id"), F.regexp_extract("path", "^[^/]*", 0).alias("repo"))
    roots = nodes.filter("kind IN ('module', 'class')").select("id")
    found = tools.foreign_callers(star.edges(spark, sf_dir, ("module", "class")).join(repo, "src_id"), roots, "ASIA")
    return found.select("repo", "caller", "path", "line", "dst_id", F.col("rank").cast("bigint").alias("rank"), F.col("in_group").cast("bigint").alias("in_group"))


@query(star.SQL + "SELECT kind, count(*) AS n FROM nodes WHERE path = 'ASIA' OR starts_with(path, 'ASIA/') GROUP BY kind")
def overview_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.overview(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), "ASIA")["kinds"]


@query(star.SQL + "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(DISTINCT path) AS files, count(*) AS symbols FROM nodes GROUP BY 1 ORDER BY symbols DESC, dir LIMIT 20")
def overview_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty directories with the most symbols (a top-k report)."""
    return tools.overview(star.nodes(spark, sf_dir), star.edges(spark, sf_dir))["dirs"]


@query(
    code.SQL
    + """, used AS (SELECT 'part:' || l_partkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 90 DAY FROM orders))
SELECT id, path, name FROM nodes WHERE kind = 'function' AND exported AND id NOT IN (SELECT id FROM used) ORDER BY path, name, id LIMIT 12"""
)
def overview_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve exported functions that no order of the last 90 days names (a top-k report)."""
    orders = star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("day"))
    late = orders.join(F.broadcast(orders.agg(F.max("day").alias("last")))).filter("day > last - INTERVAL 90 DAYS")  # one row
    items = star.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(late.select("l_orderkey"), "l_orderkey")
    used = items.select(F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("src_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst_id"), F.lit("calls").alias("type"))
    return tools.overview(code.nodes(spark, sf_dir), used)["entry_points"].select("id", "path", "name")


@query(
    code.SQL
    + """
SELECT id, path, kind FROM (SELECT *, CASE kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 WHEN 'class' THEN 2 WHEN 'interface' THEN 4 WHEN 'table' THEN 6 WHEN 'constant' THEN 7 ELSE 8 END AS k FROM nodes WHERE qualified = 'red_plate')
ORDER BY exported DESC, k, path, id LIMIT 20"""
)
def where_defined_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty definitions of one name, in order (a top-k report)."""
    return tools.where_defined(code.nodes(spark, sf_dir), "red_plate").select("id", "path", "kind")


@query(
    """
WITH p AS (SELECT p_partkey AS id, lower(p_name) AS n, p_size > 25 AS exported, p_brand AS path, p_partkey % 1000 AS line FROM part), s AS (
  SELECT *, CASE WHEN n = 'rod' THEN 0 WHEN starts_with(n, 'rod') THEN 1000 + length(n) WHEN contains(n, 'rod') THEN 10000 + 1000 * (instr(n, 'rod') - 1) + length(n)
    ELSE 100000 + 1000 * (length(regexp_extract(n, '^[^r]*r[^o]*o[^d]*d', 0)) - 3) + length(n) END + 70 + CASE WHEN exported THEN 0 ELSE 500 END AS score FROM p WHERE regexp_matches(n, 'r.*o.*d')
)
SELECT CAST(id AS BIGINT) AS id, CAST(score AS BIGINT) AS score_milli FROM s ORDER BY score, path, line, id LIMIT 5
"""
)
def not_found_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five names like the last segment of one that nothing has (a top-k report)."""
    parts = star.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name"), F.lit("constant").alias("kind"), (F.col("p_size") > 25).alias("exported"),
        F.lit("python").alias("lang"), F.col("p_brand").alias("path"), (F.col("p_partkey") % 1000).alias("line_start"),
    )
    return tools.not_found(parts, "no/such.py:rod").select("id", "score_milli")


@query("SELECT l_returnflag AS flag, median(l_quantity) AS middle, CAST(sum(l_linenumber) AS BIGINT) AS total, sum(l_linenumber) / CAST(count(*) AS DOUBLE) AS ratio FROM lineitem GROUP BY l_returnflag")
def quantity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, sum and ratio."""
    items = star.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    return items.agg(F.median("l_quantity").alias("middle"), F.sum("l_linenumber").cast("bigint").alias("total"), (F.sum("l_linenumber") / F.count("*")).alias("ratio"))


# names and modules

_WORDS = "SELECT p_partkey AS k, p_partkey % 6 AS w, p_partkey % 3 + 1 AS dots, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_brand AS r FROM part"


@query(
    f"""
WITH t AS ({_WORDS}), listed AS (
  SELECT k, CASE w
    WHEN 0 THEN ['pkg.' || a || '.' || b, a || '.' || b, b]
    WHEN 1 THEN CASE dots WHEN 1 THEN ['top.' || a || '.' || b, a || '.' || b, b, b] WHEN 2 THEN ['top.' || b, b, b] ELSE [b, b] END
    WHEN 2 THEN ['example.org/app/' || a || '/' || b, a || '/' || b, 'app/' || a || '/' || b, a || '/' || b, b]
    WHEN 3 THEN ['src/' || b, 'src/' || b || '/index']
    WHEN 4 THEN ['src/' || a || '/' || b, 'src/' || a || '/' || b || '/index', 'lib/' || a || '/' || b, 'lib/' || a || '/' || b || '/index',
                 'base/@app/' || a || '/' || b, 'base/@app/' || a || '/' || b || '/index', '@app/' || a || '/' || b, '@app/' || a || '/' || b || '/index']
    ELSE ['org.' || a] END AS l FROM t
), each AS (SELECT k, unnest(l) AS module, unnest(range(len(l))) AS i FROM listed)
SELECT CAST(k AS BIGINT) AS k, module, CAST(row_number() OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS pos FROM (SELECT k, module, min(i) AS i FROM each GROUP BY k, module)
"""
)
def import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that an import of each family may mean, in order."""
    part = star.table(spark, sf_dir, "part")
    a, b, w = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_partkey") % 6
    dots = F.expr("repeat('.', cast(p_partkey % 3 + 1 as int))")
    family = F.when(w <= 1, "python").when(w == 2, "go").when(w <= 4, "typescript").otherwise("java")
    module = (
        F.when(w == 0, F.concat(F.lit("pkg."), a, F.lit("."), b)).when(w == 1, F.concat(dots, b)).when(w == 2, F.concat(F.lit("example.org/app/"), a, F.lit("/"), b))
        .when(w == 3, F.concat(F.lit("../"), b, F.lit(".js"))).when(w == 4, F.concat(F.lit("@app/"), a, F.lit("/"), b, F.lit(".ts"))).otherwise(F.concat(F.lit("org."), a))
    )
    importer = F.concat(F.when(w == 3, F.lit("src/")).otherwise(F.lit("top/")), a, F.lit("/mod.py"))
    found = modules.candidates(family, module, importer, F.lit("example.org/app"), {"@app/*": ["src/*", "lib/*"], "@app": ["never"]}, "base")
    return part.select(F.col("p_partkey").cast("bigint").alias("k"), F.posexplode(found).alias("p", "module")).select("k", "module", (F.col("p") + 1).cast("bigint").alias("pos"))


@query(
    f"""
WITH t AS ({_WORDS}), listed AS (
  SELECT k, CASE k % 5
    WHEN 0 THEN ['top.' || a || '.' || b, a || '.' || b, b] WHEN 1 THEN ['top.' || a, a] WHEN 2 THEN ['top/' || a, a]
    WHEN 3 THEN ['top/' || a || '/index', 'top/' || a || '/index.ts', 'top/' || a || '/index.js', 'top/' || a] ELSE [a] END AS l FROM t
)
SELECT CAST(k AS BIGINT) AS k, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS pos, unnest(l) AS module FROM listed
"""
)
def file_module_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules that files of each family have."""
    part = star.table(spark, sf_dir, "part")
    a, b, w = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_partkey") % 5
    family = F.when(w <= 1, "python").when(w == 2, "go").when(w == 3, "typescript").otherwise("swift")
    path = (
        F.when(w == 0, F.concat(F.lit("top/"), a, F.lit("/"), b, F.lit(".py"))).when(w == 1, F.concat(F.lit("top/"), a, F.lit("/__init__.py")))
        .when(w == 2, F.concat(F.lit("top/"), a, F.lit("/main.go"))).when(w == 3, F.concat(F.lit("top/"), a, F.lit("/index.ts"))).otherwise(F.concat(F.lit("Sources/"), a, F.lit("/x.swift")))
    )
    return part.select(F.col("p_partkey").cast("bigint").alias("k"), F.posexplode(modules.file_modules(family, path)).alias("p", "module")).select("k", (F.col("p") + 1).cast("bigint").alias("pos"), "module")


@query(
    f"""
WITH t AS ({_WORDS})
SELECT CAST(k AS BIGINT) AS k, CASE k % 5 WHEN 4 THEN a ELSE a || ' ' || b END AS literal, '/api/' || a || '/' || b AS route, CASE WHEN k % 2 = 0 THEN a ELSE '_' || a END NOT LIKE '\\_%' ESCAPE '\\' AS in_python,
       k % 2 = 0 AS in_go, k % 4 IN (0, 1, 3) AS standard, format('{{:,}}', k * 1000) || ' ' || CASE WHEN k * 1000 = 1 THEN 'class' ELSE 'classes' END AS phrase,
       list_sort(list_distinct([b, a])) AS tables, 'pkg.' || a || '.' || b AS below
FROM t
"""
)
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals, routes, exported and standard names, phrases, tables in statements and submodules."""
    a, b, k = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_partkey")
    both = F.concat(a, F.lit(" "), b)
    literal = (
        F.when(k % 5 == 0, F.concat(F.lit('"'), both, F.lit('"'))).when(k % 5 == 1, F.concat(F.lit("r'"), both, F.lit("'"))).when(k % 5 == 2, F.concat(F.lit("`"), both, F.lit("`")))
        .when(k % 5 == 3, F.concat(F.lit("b'''"), both, F.lit("'''"))).otherwise(a)
    )
    family, module = F.when(k % 4 == 3, "swift").otherwise("python"), F.when(k % 4 == 0, "os.path").when(k % 4 == 1, "java.util").when(k % 4 == 2, "osx").otherwise("UIKit")
    statement = F.concat(F.lit("SELECT x FROM shop."), b, F.lit(" JOIN `"), F.upper(a), F.lit("` USING (y) WHERE z IN (SELECT 1 FROM unnest(q))"))
    return star.table(spark, sf_dir, "part").select(
        k.cast("bigint").alias("k"),
        text.unquote(literal).alias("literal"),
        text.join_route(F.lit("/api/"), a, F.lit(""), b).alias("route"),
        modules.exported(F.lit("python"), F.when(k % 2 == 0, a).otherwise(F.concat(F.lit("_"), a))).alias("in_python"),
        modules.exported(F.lit("go"), F.when(k % 2 == 0, F.initcap(a)).otherwise(a)).alias("in_go"),
        modules.never_local(family, module).alias("standard"),
        text.count_phrase(k * 1000, "class").alias("phrase"),
        F.sort_array(tables_in_text(statement)).alias("tables"),
        modules.submodule(F.lit("python"), F.concat(F.lit("pkg."), a), b).alias("below"),
    )


@query(code.SQL + "SELECT path, arg_min(module, (is_alias, module)) AS module FROM mods GROUP BY path")
def canonical_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module by which a file is known."""
    return code.modules(spark, sf_dir).groupBy("path").agg(F.min_by("module", F.struct("is_alias", "module")).alias("module"))


# maintenance

_REFS = """
WITH refs AS (
  SELECT event_id AS rid, user_id AS path, event_type AS type, CAST(json_extract(props, '$.k') AS VARCHAR) AS name, CAST(CAST(value AS BIGINT) % 10 AS VARCHAR) AS symbol, value > 50 AS resolved, ts FROM events
), latest AS (SELECT path, max(ts) AS t FROM refs GROUP BY path), late AS (
  SELECT path FROM latest WHERE t > (SELECT to_timestamp(epoch(max(ts)) - 3600)::TIMESTAMP FROM events)
)
"""


def _refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as refs, and the paths that changed in the last hour."""
    refs = star.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("rid"), F.col("user_id").alias("path"), F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("name"),
        (F.col("value").cast("decimal(18,0)").cast("bigint") % 10).cast("string").alias("symbol"), (F.col("value") > 50).alias("resolved"), F.col("ts").cast("timestamp").alias("ts"),
    )
    end = refs.agg(F.max("ts").alias("end"))
    latest = refs.groupBy("path").agg(F.max("ts").alias("t")).join(F.broadcast(end))  # one row
    return refs, latest.filter(F.unix_micros("t") > F.unix_micros("end") - 3_600_000_000).select("path")


@query(_REFS + "SELECT name FROM refs WHERE path IN (SELECT path FROM late) UNION SELECT symbol FROM refs WHERE path IN (SELECT path FROM late)")
def dirty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names before and after the change of some files."""
    refs, late = _refs(spark, sf_dir)
    changed = refs.join(late, "path", "left_semi")
    return store.dirty_names(changed.select("name"), changed.select(F.col("symbol").alias("name")))


@query(
    _REFS
    + """, names AS (SELECT name FROM refs WHERE path IN (SELECT path FROM late) UNION SELECT symbol FROM refs WHERE path IN (SELECT path FROM late))
SELECT rid FROM refs WHERE name IN (SELECT name FROM names) OR symbol IN (SELECT name FROM names)"""
)
def refs_by_name_or_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, late = _refs(spark, sf_dir)
    changed = refs.join(late, "path", "left_semi")
    names = store.dirty_names(changed.select("name"), changed.select(F.col("symbol").alias("name")))
    return store.refs_naming(refs, names).select("rid")


@query(_REFS + "SELECT rid, resolved OR path IN (SELECT path FROM late) AS resolved FROM refs")
def refs_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs of the files that changed last, marked as resolved."""
    refs, late = _refs(spark, sf_dir)
    return store.mark_resolved(refs, refs.join(late, "path", "left_semi").select("rid")).select("rid", "resolved")


@query(_REFS + "SELECT type, count(*) AS left_over FROM refs WHERE path NOT IN (SELECT path FROM late) GROUP BY type")
def edges_without_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships left when those of some refs are deleted."""
    refs, late = _refs(spark, sf_dir)
    gone = store.delete_by_rid(refs, refs.join(late, "path", "left_semi").select("rid"))
    return gone.groupBy("type").agg(F.count("*").alias("left_over"))


@query("SELECT count(*) AS refs, count(*) AS rids, CAST(1 AS BIGINT) AS first, count(*) AS last, CAST(0 AS BIGINT) AS astray FROM lineitem")
def numbered_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of new refs: gapless, unique, and in the order of their file."""
    rows = star.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ordinal"))
    made = kept(store.with_rids(rows, ["path"], ["ordinal"]), "new-refs")
    files = made.groupBy("path").agg((F.max("rid") - F.min("rid") + 1 - F.count("*")).alias("gap"))
    counts = made.agg(F.count("*").alias("refs"), F.count_distinct("rid").alias("rids"), F.min("rid").alias("first"), F.max("rid").alias("last"))
    return counts.join(F.broadcast(files.agg(F.sum("gap").alias("astray"))))  # a row each


@query(star.SQL + "SELECT DISTINCT src_id AS id FROM edges WHERE src_id IN (SELECT id FROM nodes WHERE kind = 'function')")
def existing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = star.nodes(spark, sf_dir).filter("kind = 'function'").select("id")
    return star.edges(spark, sf_dir).select(F.col("src_id").alias("id")).distinct().join(own, "id", "left_semi")


# the question tools, from names to answers

_CALLS = ", ".join(f"'{t}'" for t in CALL_TYPES)


@query(star.SQL + f"SELECT DISTINCT n.qualified AS root, s.id, CAST(1 AS BIGINT) AS distance FROM nodes n JOIN edges e ON e.dst_id = n.id AND e.type IN ({_CALLS}) JOIN nodes s ON s.id = e.src_id WHERE n.kind = 'struct' AND s.id <> n.id")
def callers_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the name of each supplier to what calls it."""
    nodes = kept(star.nodes(spark, sf_dir), "nodes")
    names = nodes.filter("kind = 'struct'").select(F.col("qualified").alias("q"))
    found = tools.find_callers(nodes, star.edges(spark, sf_dir), names, 1, evidence=False)
    return found.select("root", "id", F.col("distance").cast("bigint").alias("distance"))


@query(
    star.SQL
    + """, asked AS (SELECT id FROM nodes WHERE kind = 'module')
, sides AS (
  SELECT id, 'out' AS direction, dst_id AS other, type, conf_rank, e.path, line, confidence FROM asked JOIN ranked_edges e ON src_id = id
  UNION ALL SELECT id, 'in', src_id, type, conf_rank, e.path, line, confidence FROM asked JOIN ranked_edges e ON dst_id = id
), dedup AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, direction, other, type ORDER BY conf_rank, path, line, confidence) AS k FROM sides) WHERE k = 1
), capped AS (
  SELECT *, row_number() OVER (PARTITION BY id, direction, type ORDER BY conf_rank, path, line, other) AS r, count(*) OVER (PARTITION BY id, direction, type) AS n FROM dedup
)
SELECT c.id, direction, type, other, s.name AS other_name, s.path AS other_path, CAST(r AS BIGINT) AS rank, CAST(n AS BIGINT) AS in_group FROM capped c LEFT JOIN nodes s ON s.id = other WHERE r <= 12"""
)
def symbol_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations with a dozen named neighbours of each kind."""
    nodes = kept(star.nodes(spark, sf_dir), "nodes")
    found = tools.get_symbol(nodes, star.edges(spark, sf_dir), nodes.filter("kind = 'module'").select("id"))
    return found.select("id", "direction", "type", "other", "other_name", "other_path", F.col("rank").cast("bigint").alias("rank"), F.col("in_group").cast("bigint").alias("in_group"))


@query(
    star.SQL
    + f""", changed AS (SELECT DISTINCT path FROM nodes WHERE kind = 'struct')
, reach AS (
  SELECT n.path AS root, n.id, CAST(0 AS BIGINT) AS d FROM nodes n JOIN changed USING (path) WHERE n.kind <> 'module'
  UNION SELECT root, e.src_id, d + 1 FROM reach JOIN edges e ON e.dst_id = reach.id WHERE d < 1 AND e.type IN ({_TYPES})
)
SELECT root, id, min(d) AS distance FROM reach JOIN nodes n USING (id) WHERE n.path <> root GROUP BY root, id HAVING min(d) > 0"""
)
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on each changed file from outside of it, symbol by symbol."""
    nodes = kept(star.nodes(spark, sf_dir), "nodes")
    found = tools.changed_since(nodes, star.edges(spark, sf_dir), nodes.filter("kind = 'struct'").select("path"), 1, None, evidence=False)
    return found.select("root", "id", F.col("distance").cast("bigint").alias("distance"))


@query(
    star.SQL
    + """SELECT 'files' AS what, count(DISTINCT path) AS n FROM nodes UNION ALL SELECT 'symbols', count(*) FROM nodes UNION ALL SELECT 'relationships', count(*) FROM edges
UNION ALL SELECT 'open', count(*) FROM events WHERE NOT (value > 50)"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = star.table(spark, sf_dir, "events").select((F.col("value") > 50).alias("resolved"))
    return tools.status(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), refs)["counts"]


@query(star.SQL + "SELECT type, confidence, count(*) AS n FROM edges GROUP BY GROUPING SETS ((type), (confidence))")
def status_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships by type and by confidence, in one pass."""
    refs = star.table(spark, sf_dir, "events").select((F.col("value") > 50).alias("resolved"))
    return tools.status(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), refs)["edges"]


@query(
    """
WITH aliases AS (
  SELECT n_nationkey AS project, 0 AS place, '@' || lower(n_name) || '/*' AS pattern, ['src/' || n_nationkey || '/*', 'lib/*'] AS targets FROM nation
  UNION ALL SELECT n_nationkey, 1, 'main', ['src/main' || n_nationkey] FROM nation
  UNION ALL SELECT n_nationkey, 2, '*.svg', ['img/*.png', 'img/*.svg'] FROM nation UNION ALL SELECT n_nationkey, 3, '@' || lower(left(n_name, 2)) || '*er', ['short/*', 'fixed'] FROM nation
), refs AS (
  SELECT c_custkey AS rid, c_nationkey AS project, CASE c_custkey % 5 WHEN 0 THEN '@' || lower(n_name) || '/c' || c_custkey WHEN 1 THEN 'main' WHEN 2 THEN '@' || lower(n_name) || '/x.svg' WHEN 3 THEN '@' || lower(left(n_name, 2)) || c_custkey || 'er' ELSE 'other/' || c_custkey END AS module
  FROM customer JOIN nation ON n_nationkey = c_nationkey
), hits AS (
  SELECT rid, place, unnest(range(1, len(targets) + 1)) AS k, unnest(list_transform(targets, lambda t: replace(t, '*', CASE WHEN contains(pattern, '*') THEN substr(module, length(split_part(pattern, '*', 1)) + 1, length(module) - length(pattern) + 1) ELSE '*' END))) AS made
  FROM refs JOIN aliases USING (project) WHERE module = pattern OR contains(pattern, '*') AND starts_with(module, split_part(pattern, '*', 1)) AND ends_with(module, split_part(pattern, '*', 2)) AND length(module) >= length(pattern) - 1
)
SELECT rid, string_agg(made, ' ' ORDER BY place, k) AS candidates FROM hits GROUP BY rid
"""
)
def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path aliases of many projects at once: whole names, prefixes, suffixes and both."""
    nation = star.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"), F.lower("n_name").alias("name"))
    text_ = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    one = lambda k, pattern, *targets: F.struct(F.lit(k).alias("place"), pattern.alias("pattern"), F.array(*targets).alias("targets"))
    project = F.col("project")
    each = F.array(
        one(0, text_("@", F.col("name"), "/*"), text_("src/", project, "/*"), F.lit("lib/*")), one(1, F.lit("main"), text_("src/main", project)),
        one(2, F.lit("*.svg"), F.lit("img/*.png"), F.lit("img/*.svg")), one(3, text_("@", F.substring("name", 1, 2), "*er"), F.lit("short/*"), F.lit("fixed")),
    )
    aliases = nation.select("project", F.explode(each).alias("a")).select("project", "a.*")
    rows = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_nationkey").alias("project")).join(F.broadcast(nation), "project")  # 25 rows by definition
    turn, rid, name = F.col("rid") % 5, F.col("rid"), F.col("name")
    module = (
        F.when(turn == 0, text_("@", name, "/c", rid)).when(turn == 1, "main").when(turn == 2, text_("@", name, "/x.svg")).when(turn == 3, text_("@", F.substring("name", 1, 2), rid, "er")).otherwise(text_("other/", rid))
    )
    found = resolve.alias_targets(rows.select("rid", "project", module.alias("module")), aliases)
    return found.select("rid", F.array_join("candidates", " ").alias("candidates"))
