"""A source tree over the sales tables: parts are definitions in files by brand, line items refer to them.

Files import their neighbours among the brands in each of the ways that imports have: whole, by name, under
a name, whole without a name, by default and as a module below a package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.modules import file_modules
from .star import table

KINDS = ("function", "method", "class", "constant", "table", "interface")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, b, g, path, id, name, qualified, kind and exported of each part."""
    part = table(spark, sf_dir, "part")
    b, g = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint") % 25, F.floor(F.col("p_partkey") / 400)
    base = F.replace("p_name", F.lit(" "), F.lit("_"))
    name = F.when(F.col("p_partkey") % 3 == 0, _text(base, "_", F.col("p_partkey") % 500)).otherwise(base)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_size") % 6 + 1).cast("int"))
    rows = part.select(F.col("p_partkey").alias("key"), b.alias("b"), g.alias("g"), name.alias("name"), kind.alias("kind"), (F.col("p_size") > 25).alias("exported"))
    own = F.when(F.col("kind") == "method", _text("T", F.col("b"), "x", F.col("g"), ".", F.col("name"))).otherwise(F.col("name"))
    return rows.select("*", _text("b", F.col("b"), "/f", F.col("g"), ".py").alias("path"), _text("part:", F.col("key")).alias("id"), own.alias("qualified"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b, g, path and the first name that a file defines.

    Parts are dealt by file before they are grouped: names are sorted for that, and few tasks read the parts.
    """
    return definitions(spark, sf_dir).select("b", "g", "path", "name").repartition("path").groupBy("b", "g", "path").agg(F.min("name").alias("first"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, name, qualified, kind and exported: definitions, and a module and a type for each file."""
    own, all_ = definitions(spark, sf_dir), files(spark, sf_dir)
    type_ = _text("T", F.col("b"), "x", F.col("g"))
    module = all_.select(_text("module:", F.col("path")).alias("id"), "path", _text("f", F.col("g")).alias("name"), _text("f", F.col("g")).alias("qualified"), F.lit("module").alias("kind"), F.lit(True).alias("exported"))
    types = all_.select(_text("type:", F.col("path")).alias("id"), "path", type_.alias("name"), type_.alias("qualified"), F.lit("class").alias("kind"), F.lit(True).alias("exported"))
    return own.select("id", "path", "name", "qualified", "kind", "exported").unionByName(module).unionByName(types)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of a brand each are a package with one scope."""
    package = _text("b", F.col("b"), "/", F.floor(F.col("g") / 2))
    return files(spark, sf_dir).select("path", package.alias("package"), F.lit(True).alias("shared"), F.lit(False).alias("wide"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = files(spark, sf_dir).select("path", F.posexplode(file_modules(F.lit("python"), F.col("path"))).alias("pos", "module"))
    return keys.select("path", F.lit("python").alias("family"), "module", (F.col("pos") > 0).alias("is_alias"))


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's type is based on that of the next brand."""
    all_ = files(spark, sf_dir)
    up = all_.select(((F.col("b") + 24) % 25).alias("b"), "g", _text("type:", F.col("path")).alias("base"))
    return all_.join(up, ["b", "g"]).select(_text("type:", F.col("path")).alias("owner"), "base")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, path, family, module, symbol and alias."""
    all_ = files(spark, sf_dir)

    def first(step: int) -> DataFrame:
        return all_.select(((F.col("b") + 25 - step) % 25).alias("b"), "g", F.col("first").alias(f"first{step}"))

    rows = all_.join(first(5), ["b", "g"], "left").join(first(9), ["b", "g"], "left")
    module = lambda step: _text("b", (F.col("b") + step) % 25, ".f", F.col("g"))
    none = F.lit(None).cast("string")
    ways = [
        (module(2), none, F.lit("m")),
        (module(3), _text("T", (F.col("b") + 3) % 25, "x", F.col("g")), F.lit("Tb")),
        (module(4), none, none),
        (module(5), F.col("first5"), F.col("first5")),
        (module(5), F.col("first9"), F.col("first9")),
        (module(6), F.lit("default"), F.lit("d")),
        (_text("b", (F.col("b") + 7) % 25), _text("f", F.col("g")), F.lit("s")),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("k"), m.alias("module"), s.alias("symbol"), a.alias("alias")) for k, (m, s, a) in enumerate(ways)])
    listed = rows.select("b", "g", "path", F.explode(each).alias("i"))
    return listed.select(((F.col("b") * 100_000 + F.col("g")) * 10 + F.col("i.k")).alias("rid"), "path", F.lit("python").alias("family"), "i.module", "i.symbol", "i.alias")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, src_id, path, type, name and qualifier: line items, and a call to each supplier, a symbol of a linked tree."""
    own = definitions(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("key"))
    source = own.select("key", F.col("id").alias("src_id"), "path", "b", "g")
    target = own.select(F.col("key").alias("l_partkey"), "name")
    joined = items.join(orders, "l_orderkey").join(source, "key").join(target, "l_partkey")
    type_ = F.when((F.col("l_orderkey") + F.col("l_partkey")) % 5 == 0, "queries").when((F.col("l_orderkey") + F.col("l_partkey")) % 5 == 1, "references").otherwise("calls")
    turn = F.col("l_orderkey") % 9
    qualifier = (
        F.when(turn == 3, "self").when(turn == 4, "m").when(turn == 5, "Tb").when(turn == 6, _text("T", F.col("b"), "x", F.col("g"))).when(turn == 7, "other").when(turn == 8, "s.x")
    )
    named = joined.select((F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey")).alias("rid"), "src_id", "path", type_.alias("type"), "name", qualifier.alias("qualifier"))
    calls = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).join(source, "key")
    return named.unionByName(calls.select((-F.col("key") - 1).alias("rid"), "src_id", "path", F.lit("calls").alias("type"), "name", F.lit(None).cast("string").alias("qualifier")))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the symbols of another tree."""
    rows = table(spark, sf_dir, "supplier")
    return rows.select(_text("supplier:", F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("function").alias("kind"), (F.col("s_acctbal") > 0).alias("exported"))


#: The same tables in SQL, to stand before a query.
SQL = """
WITH RECURSIVE defs AS (
  SELECT *, 'b' || b || '/f' || g || '.py' AS path, 'part:' || key AS id, CASE WHEN kind = 'method' THEN 'T' || b || 'x' || g || '.' || name ELSE name END AS qualified,
         CASE kind WHEN 'function' THEN 0 WHEN 'method' THEN 1 WHEN 'class' THEN 2 WHEN 'struct' THEN 3 WHEN 'interface' THEN 4 WHEN 'constant' THEN 5 WHEN 'table' THEN 6 ELSE 7 END AS pr FROM (
    SELECT p_partkey AS key, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) % 25 AS b, CAST(p_partkey AS BIGINT) // 400 AS g,
           replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '_' || (p_partkey % 500) ELSE '' END AS name,
           ['function', 'method', 'class', 'constant', 'table', 'interface'][p_size % 6 + 1] AS kind, p_size > 25 AS exported FROM part
  )
), files AS (
  SELECT b, g, path, min(name) AS first FROM defs GROUP BY b, g, path
), syms AS (
  SELECT id, path, name, qualified, kind, exported, pr FROM defs
  UNION ALL SELECT 'type:' || path, path, 'T' || b || 'x' || g, 'T' || b || 'x' || g, 'class', true, 2 FROM files
), nodes AS (
  SELECT * FROM syms UNION ALL SELECT 'module:' || path, path, 'f' || g, 'f' || g, 'module', true, 8 FROM files
), mods AS (
  SELECT path, 'b' || b || '.f' || g AS module, false AS is_alias FROM files UNION ALL SELECT path, 'f' || g, true FROM files
), bases AS (
  SELECT 'type:' || f.path AS owner, 'type:' || u.path AS base FROM files f JOIN files u ON u.g = f.g AND u.b = (f.b + 1) % 25
), imps AS (
  SELECT (f.b * 100000 + f.g) * 10 + k AS rid, f.path,
         CASE k WHEN 0 THEN 'b' || ((f.b + 2) % 25) || '.f' || f.g WHEN 1 THEN 'b' || ((f.b + 3) % 25) || '.f' || f.g WHEN 2 THEN 'b' || ((f.b + 4) % 25) || '.f' || f.g
           WHEN 5 THEN 'b' || ((f.b + 6) % 25) || '.f' || f.g WHEN 6 THEN 'b' || ((f.b + 7) % 25) ELSE 'b' || ((f.b + 5) % 25) || '.f' || f.g END AS module,
         CASE k WHEN 1 THEN 'T' || ((f.b + 3) % 25) || 'x' || f.g WHEN 3 THEN f5.first WHEN 4 THEN f9.first WHEN 5 THEN 'default' WHEN 6 THEN 'f' || f.g END AS symbol,
         CASE k WHEN 0 THEN 'm' WHEN 1 THEN 'Tb' WHEN 3 THEN f5.first WHEN 4 THEN f9.first WHEN 5 THEN 'd' WHEN 6 THEN 's' END AS alias
  FROM files f CROSS JOIN (SELECT unnest(range(7)) AS k) LEFT JOIN files f5 ON f5.g = f.g AND f5.b = (f.b + 5) % 25 LEFT JOIN files f9 ON f9.g = f.g AND f9.b = (f.b + 9) % 25
), tried AS (
  SELECT rid, path, 0 AS pos, module FROM imps UNION ALL SELECT rid, path, 1, split_part(module, '.', 2) FROM imps WHERE contains(module, '.')
), found AS (
  SELECT rid, arg_min(m.path, (pos, is_alias, m.path)) AS file FROM tried t JOIN mods m ON m.module = t.module AND m.path <> t.path GROUP BY rid
), below AS (
  SELECT i.rid, arg_min('module:' || m.path, (pos, is_alias, m.path)) AS nested FROM (
    SELECT rid, path, unnest([0, 1, 2]) AS pos, unnest([module || '.' || symbol, array_to_string(string_split(module || '.' || symbol, '.')[2:], '.'), array_to_string(string_split(module || '.' || symbol, '.')[3:], '.')]) AS module FROM imps WHERE symbol IS NOT NULL
  ) i JOIN mods m ON m.module = i.module AND m.path <> i.path GROUP BY i.rid
), best AS (
  SELECT path, name, arg_min(id, (pr, NOT exported, path, id)) AS id, count(*) AS n FROM syms GROUP BY path, name
), walk AS (
  SELECT DISTINCT file, symbol, file AS at, symbol AS ask, 0 AS hop, CAST([] AS BIGINT[]) AS way FROM imps JOIN found USING (rid) WHERE symbol <> 'default'
  UNION ALL
  SELECT w.file, w.symbol, n.file, coalesce(i.symbol, w.ask), hop + 1, list_append(way, i.rid) FROM walk w JOIN imps i ON i.path = w.at JOIN found n ON n.rid = i.rid
  WHERE hop < 4 AND ((i.symbol IS NOT NULL AND i.alias = w.ask) OR (i.symbol IS NULL AND i.alias IS NULL)) AND NOT EXISTS (SELECT 1 FROM best b WHERE b.path = w.at AND b.name = w.ask)
), exported AS (
  SELECT file, symbol, arg_min(b.id, (hop, way)) AS id FROM walk JOIN best b ON b.path = walk.at AND b.name = walk.ask GROUP BY file, symbol
  UNION ALL SELECT path, 'default', arg_min(id, (pr, NOT exported, path, id)) FROM syms WHERE exported GROUP BY path
), placed AS (
  SELECT p.*, n.kind, n.path AS target_path, CASE WHEN n.path <> p.file THEN 'module:' || p.file END AS via FROM (
    SELECT i.rid, i.path, i.alias, i.symbol, f.file, coalesce(e.id, nested, 'module:' || f.file) AS id
    FROM imps i LEFT JOIN found f USING (rid) LEFT JOIN exported e ON e.file = f.file AND e.symbol = i.symbol LEFT JOIN below USING (rid)
  ) p JOIN nodes n USING (id)
), refs AS (
  SELECT CAST(l_orderkey AS BIGINT) * 1000000000 + l_partkey AS rid, s.id AS src_id, s.path, s.qualified AS src_qualified,
         CASE (l_orderkey + l_partkey) % 5 WHEN 0 THEN 'queries' WHEN 1 THEN 'references' ELSE 'calls' END AS type, t.name,
         CASE l_orderkey % 9 WHEN 3 THEN 'self' WHEN 4 THEN 'm' WHEN 5 THEN 'Tb' WHEN 6 THEN 'T' || s.b || 'x' || s.g WHEN 7 THEN 'other' WHEN 8 THEN 's.x' END AS qualifier
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN defs s ON s.key = o_custkey JOIN defs t ON t.key = l_partkey
  UNION ALL SELECT -s_suppkey - 1, d.id, d.path, d.qualified, 'calls', s_name, NULL FROM supplier JOIN defs d ON d.key = s_suppkey
)
"""
