"""Queries over files, snapshots, names and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lookup, rank, resolve, store
from ..operators.rank import tokens
from ..sources import star
from ..sources.pages import hrefs, module_keys
from ..streaming import upkeep
from ..streaming.changes import sessions
from ..tables import kept

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CAST(length(text) AS BIGINT) AS chars FROM documents")
def token_estimate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"), F.length("text").cast("bigint").alias("chars"))


@query("SELECT source || '/' || doc_id AS path, substr(sha256(text), 1, 32) AS hash, n_chars AS size, lang FROM documents")
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, content hash, size and language."""
    docs = star.table(spark, sf_dir, "documents")
    return docs.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), text.content_hash(F.col("text")).alias("hash"), F.col("n_chars").alias("size"), "lang"
    )


@query("SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = star.table(spark, sf_dir, "documents").filter("lang IS NOT NULL")
    return docs.groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, count(*) AS skipped FROM documents WHERE n_chars > 2000 OR lang NOT IN ('en', 'de', 'fr') GROUP BY lang")
def files_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission by size and language."""
    docs = star.table(spark, sf_dir, "documents")
    return docs.filter((F.col("n_chars") > 2000) | ~F.col("lang").isin("en", "de", "fr")).groupBy("lang").agg(F.count("*").alias("skipped"))


@query(
    r"""
SELECT doc_id, CASE WHEN regexp_matches(p, '[\p{L}\p{N}]') THEN CASE WHEN length(p) <= 200 THEN p ELSE substr(p, 1, 197) || '...' END END AS doc FROM (
  SELECT doc_id, trim(regexp_replace(split_part(ltrim(text, ' ' || chr(10)), chr(10), 1), '[ \t]+', ' ', 'g')) AS p FROM documents
)
"""
)
def doc_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line, squashed and cut, if it says anything."""
    line = F.split(F.ltrim("text", F.lit(" \n")), "\n")[0]
    return star.table(spark, sf_dir, "documents").select("doc_id", text.first_paragraph(line).alias("doc"))


@query(
    """
SELECT p_partkey, CASE WHEN length(t) <= 12 THEN t ELSE substr(t, 1, 9) || '...' END AS short, rpad(p_brand, CAST(greatest(12, length(p_brand)) AS INTEGER), ' ') AS padded,
       p_size || ' ' || CASE WHEN p_size = 1 THEN lower(p_type) WHEN regexp_matches(lower(p_type), '(s|x|z|ch|sh)$') THEN lower(p_type) || 'es'
         WHEN regexp_matches(lower(p_type), '[^aeiou]y$') THEN regexp_replace(lower(p_type), 'y$', 'ies') ELSE lower(p_type) || 's' END AS phrase,
       regexp_matches(p_type, '^[A-Z][A-Z0-9_]*$') AND length(p_type) > 1 AS constant
FROM (SELECT *, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS t FROM part)
"""
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = star.table(spark, sf_dir, "part")
    noun = F.lower("p_type")
    return part.select(
        "p_partkey",
        text.truncate(text.squash(F.col("p_name")), 12).alias("short"),
        text.pad(F.col("p_brand"), 12).alias("padded"),
        F.concat(F.col("p_size").cast("string"), F.lit(" "), text.plural(F.col("p_size"), noun)).alias("phrase"),
        text.looks_constant(F.col("p_type")).alias("constant"),
    )


_SCORED = """
WITH p AS (SELECT p_partkey AS id, lower(p_name) AS n, p_size > 25 AS exported, p_partkey % 1000 AS line FROM part), s AS (
  SELECT *, CASE WHEN n = 'al' THEN 0 WHEN starts_with(n, 'al') THEN 1000 + length(n) WHEN contains(n, 'al') THEN 10000 + 1000 * (instr(n, 'al') - 1) + length(n)
    WHEN instr(n, 'a') > 0 AND contains(substr(n, instr(n, 'a') + 1), 'l') THEN 100000 + 1000 * (instr(n, 'a') - 1 + instr(substr(n, instr(n, 'a') + 1), 'l') - 1) + length(n) END AS score FROM p
)
SELECT CAST(id AS BIGINT) AS id, CAST(score + 70 + CASE WHEN exported THEN 0 ELSE 500 END AS BIGINT) AS score_milli FROM s WHERE score IS NOT NULL
"""


@query(_SCORED)
def fuzzy_search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts whose name has the letters of the query in order, with their scores."""
    parts = star.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("constant").alias("kind"), (F.col("p_size") > 25).alias("exported"), F.lit("python").alias("lang")
    )
    return lookup.search(parts, "al").select("id", "score_milli")


_FUZZY = """
WITH n AS (
  SELECT 'part:' || p_partkey AS id, lower(p_name) AS low, 'part/' || p_size AS path, p_partkey % 1000 + 1 AS line, 70 + CASE WHEN p_size > 25 THEN 0 ELSE 500 END AS w FROM part
  UNION ALL SELECT 'customer:' || c_custkey, lower(c_name), 'customer/' || c_nationkey, c_custkey % 1000 + 1, 20 + CASE WHEN c_acctbal > 0 THEN 0 ELSE 500 END FROM customer
), asked AS (
  SELECT DISTINCT trim(q) AS q, lower(trim(q)) AS want FROM (
    SELECT 'C#' || s_suppkey AS q FROM supplier UNION ALL SELECT substr(s_name, 5, 6) || 'x' FROM supplier
    UNION ALL SELECT substr(p_name, 1, 2) || right(p_name, 3) FROM part UNION ALL SELECT substr(p_name, 2, 4) FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT left(c_name, 1) FROM customer
  )
), walked AS (
  SELECT q, want, n.*, list_reduce(list_prepend(0, list_transform(string_split(want, ''), lambda c: unicode(c))),
    lambda a, c: CASE WHEN a < 0 OR instr(substr(low, a + 1), chr(c)) = 0 THEN -1 ELSE a + instr(substr(low, a + 1), chr(c)) END) AS last
  FROM asked CROSS JOIN n
), hits AS (
  SELECT q, id, path, line, CAST(w + CASE WHEN low = want THEN 0 WHEN starts_with(low, want) THEN 1000 + length(low) WHEN contains(low, want) THEN 10000 + 1000 * (instr(low, want) - 1) + length(low)
    ELSE 100000 + 1000 * (last - length(want)) + length(low) END AS BIGINT) AS score_milli FROM walked WHERE last >= 0
)
SELECT q, CAST(k AS INTEGER) AS rank, id, score_milli FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score_milli, path, line, id) AS k FROM hits) WHERE k <= 12
"""


@query(_FUZZY)
def fuzzy_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best fuzzy hits of many names at once: prefixes, infixes, subsequences, and names that fit nothing."""
    part, customer, supplier = (star.table(spark, sf_dir, t) for t in ("part", "customer", "supplier"))
    text_ = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    node = lambda df, kind, id_, name, path, line, seen: df.select(id_.alias("id"), F.col(name).alias("name"), F.lit(kind).alias("kind"), path.alias("path"), line.cast("int").alias("line_start"), seen.alias("exported"))
    nodes = node(part, "constant", text_("part:", F.col("p_partkey")), "p_name", text_("part/", F.col("p_size")), F.col("p_partkey") % 1000 + 1, F.col("p_size") > 25).unionByName(
        node(customer, "class", text_("customer:", F.col("c_custkey")), "c_name", text_("customer/", F.col("c_nationkey")), F.col("c_custkey") % 1000 + 1, F.col("c_acctbal") > 0)
    )
    asked = supplier.select(text_("C#", F.col("s_suppkey")).alias("q")).union(supplier.select(text_(F.substring("s_name", 5, 6), "x"))).union(
        part.select(F.explode(F.array(F.concat(F.substring("p_name", 1, 2), F.right("p_name", F.lit(3))), F.substring("p_name", 2, 4), F.col("p_name"))))
    ).union(customer.select(F.substring("c_name", 1, 1)))
    return lookup.fuzzy_batch(asked, nodes)


@query(
    """
WITH n AS (
  SELECT 'repo:' || p_brand || '.py:x:' || p_partkey AS id, replace(p_name, ' ', '_') AS name, p_mfgr || '.' || replace(p_name, ' ', '_') AS qualified, 'part/' || p_brand || '.py' AS path, 'part.' || p_brand AS module
  FROM (SELECT *, 'T' || (p_size % 7) AS p_mfgr FROM part)
), q AS (
  SELECT DISTINCT q FROM (
    SELECT 'repo:' || p_brand || '.py:x:' || (p_partkey * 3) AS q FROM part UNION ALL SELECT 'part/' || p_brand || '.py:' || replace(p_name, ' ', '_') FROM part
    UNION ALL SELECT 'T' || (p_size % 9) || '.' || replace(p_name, ' ', '_') FROM part UNION ALL SELECT upper(replace(p_name, ' ', '_')) FROM part
    UNION ALL SELECT 'part.' || p_brand || '.T' || (p_size % 7) || '.' || replace(p_name, ' ', '_') FROM part
    UNION ALL SELECT p_brand || '.' || replace(p_name, ' ', '_') FROM part UNION ALL SELECT 'no.where.' || replace(p_name, ' ', '_') FROM part UNION ALL SELECT replace(p_name, ' ', '_') FROM part
  )
), splits AS (
  SELECT q, i, array_to_string(string_split(q, '.')[:i], '.') AS head, array_to_string(string_split(q, '.')[i + 1:], '.') AS tail FROM (SELECT q, unnest(range(1, len(string_split(q, '.')))) AS i FROM q)
), hits AS (
  SELECT q, 0 AS r, 0 AS i, id FROM q JOIN n ON id = q WHERE len(string_split(q, ':')) >= 4
  UNION ALL SELECT q, 1, 0, id FROM q JOIN n ON path = regexp_extract(q, '^(.+[.][a-zA-Z]+):([A-Za-z_][A-Za-z0-9_.]*)$', 1) AND regexp_extract(q, '^(.+[.][a-zA-Z]+):([A-Za-z_][A-Za-z0-9_.]*)$', 2) IN (name, qualified)
  UNION ALL SELECT q, 2, 0, id FROM q JOIN n ON qualified = q
  UNION ALL SELECT q, 3, 0, id FROM q JOIN n ON name = q
  UNION ALL SELECT q, 4, i, id FROM splits JOIN n ON qualified = tail WHERE contains(module, head)
  UNION ALL SELECT q, 4, i, id FROM splits JOIN n ON name = tail WHERE contains(module, head)
  UNION ALL SELECT q, 5, 0, id FROM q JOIN n ON name = string_split(q, '.')[-1] WHERE contains(q, '.')
  UNION ALL SELECT q, 6, 0, id FROM q JOIN n ON lower(name) = lower(q)
)
SELECT DISTINCT q, ['id', 'in_file', 'qualified', 'name', 'dotted', 'last_segment', 'any_case'][r + 1] AS rung, id
FROM (SELECT *, min((r, i)) OVER (PARTITION BY q) AS least FROM hits) WHERE (r, i) = least
"""
)
def lookup_ladder_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight ways to ask for each part, through all rungs at once."""
    part = star.table(spark, sf_dir, "part")
    name, type_ = F.replace("p_name", F.lit(" "), F.lit("_")), F.concat(F.lit("T"), (F.col("p_size") % 7).cast("string"))
    nodes = part.select(
        F.concat(F.lit("repo:"), "p_brand", F.lit(".py:x:"), F.col("p_partkey").cast("string")).alias("id"), name.alias("name"),
        F.concat_ws(".", type_, name).alias("qualified"), F.concat(F.lit("part/"), "p_brand", F.lit(".py")).alias("path"), F.concat(F.lit("part."), "p_brand").alias("module"),
    )
    asked = F.array(
        F.concat(F.lit("repo:"), "p_brand", F.lit(".py:x:"), (F.col("p_partkey") * 3).cast("string")), F.concat(F.lit("part/"), "p_brand", F.lit(".py:"), name),
        F.concat(F.lit("T"), (F.col("p_size") % 9).cast("string"), F.lit("."), name), F.upper(name), F.concat(F.lit("part."), "p_brand", F.lit("."), type_, F.lit("."), name),
        F.concat_ws(".", "p_brand", name), F.concat(F.lit("no.where."), name), name,
    )
    return lookup.ladder(part.select(F.explode(asked).alias("q")), nodes)


@query(
    """
WITH m AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS u FROM pages)
SELECT page_id, CAST(i AS BIGINT) AS pos, array_to_string(list_slice(parts, i, len(parts)), '/') AS module FROM (
  SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT page_id, string_split(u, '/') AS parts FROM m)
)
"""
)
def module_suffix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's address as a module: itself and every suffix of it."""
    keys = module_keys(star.table(spark, sf_dir, "pages"))
    return keys.select("page_id", F.posexplode("candidates").alias("p", "module")).select("page_id", (F.col("p") + 1).cast("bigint").alias("pos"), "module")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hrefs(star.table(spark, sf_dir, "pages"))


@query(
    """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT href, count(*) AS links, count(DISTINCT page_id) AS pages FROM l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = href) GROUP BY href
"""
)
def dangling_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to no known page."""
    pages = star.table(spark, sf_dir, "pages")
    loose = hrefs(pages).join(pages.select(F.col("url").alias("href")), "href", "left_anti")
    return loose.groupBy("href").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


@query(
    """
WITH imp AS (
  SELECT o_orderkey AS rid, 'orders' AS importer, unnest(range(1, 4)) AS pos, o_custkey AS k FROM orders
), tried AS (
  SELECT rid, pos, 'c' || (k * pos % 5000) AS module FROM imp
), mods AS (
  SELECT 'customer/' || c_custkey AS path, 'c' || (c_custkey * 2) AS module, c_custkey % 3 = 0 AS is_alias FROM customer
)
SELECT CAST(rid AS BIGINT) AS rid, path FROM (
  SELECT rid, path, row_number() OVER (PARTITION BY rid ORDER BY pos, is_alias, path) AS r FROM tried JOIN mods USING (module)
) WHERE r = 1
"""
)
def import_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as imports of three candidate modules; the first that a customer file has wins."""
    tried = [F.concat(F.lit("c"), (F.col("o_custkey") * i % 5000).cast("string")) for i in (1, 2, 3)]
    imports = star.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rid"), F.lit("orders").alias("path"), F.lit("x").alias("family"), F.array(*tried).alias("candidates")
    )
    modules = star.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("path"), F.lit("x").alias("family"),
        F.concat(F.lit("c"), (F.col("c_custkey") * 2).cast("string")).alias("module"), (F.col("c_custkey") % 3 == 0).alias("is_alias"),
    )
    return resolve.first_hit(imports, modules)


@query(
    """
SELECT CAST(page_id AS BIGINT) AS rid, first(k ORDER BY length(k) DESC) AS package FROM (
  SELECT page_id, array_to_string(list_slice(parts, 1, i), '/') AS k FROM (
    SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts FROM pages)
  )
) WHERE k IN (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) FROM pages UNION SELECT regexp_extract(url, '^[a-z]+://([^/]*/[^/?#]*)', 1) FROM pages)
GROUP BY page_id
"""
)
def longest_prefix_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest package that holds a page: its host and first folder, or its host if it is in none."""
    pages = star.table(spark, sf_dir, "pages")
    refs = module_keys(pages).select(F.col("page_id").alias("rid"), F.col("candidates")[0].alias("module"))
    hosts = pages.select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("package"))
    folders = pages.select(F.regexp_extract("url", "^[a-z]+://([^/]*/[^/?#]*)", 1).alias("package"))
    return resolve.longest_prefix(refs, hosts.union(folders))


_SNAPSHOTS = """
WITH versions AS (
  SELECT user_id AS path, ts, event_id, event_type, CAST(json_extract(props, '$.k') AS VARCHAR) AS hash, CAST(value AS BIGINT) AS size, epoch_us(ts) AS mtime_ms FROM events
), half AS (SELECT to_timestamp((epoch(min(ts)) + epoch(max(ts))) / 2)::TIMESTAMP AS t FROM events),
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM versions WHERE ts <= (SELECT t FROM half)) WHERE r = 1 AND event_type <> 'error'),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM versions) WHERE r = 1 AND event_type <> 'error')
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as file versions, errors as deletions: what is there half-way and at the end."""
    events = star.table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    versions = events.select(
        F.col("user_id").alias("path"), "ts", "event_id", "event_type", F.get_json_object("props", "$.k").alias("hash"), F.col("value").cast("bigint").alias("size"), micros.alias("mtime_ms"),
    )
    bounds = versions.agg(((F.min(micros) + F.max(micros)) / 2).alias("t"))
    order = [F.col("ts"), F.col("event_id")]
    early = versions.join(F.broadcast(bounds)).filter(micros <= F.col("t")).drop("t")  # one row
    return tuple(store.upsert(v, ["path"], order).filter("event_type <> 'error'") for v in (early, versions))


@query(
    _SNAPSHOTS
    + """
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.size = b.size AND a.mtime_ms = b.mtime_ms THEN 'same' WHEN a.hash = b.hash THEN 'touched' ELSE 'modified' END AS change
FROM old a FULL JOIN new b ON a.path = b.path
"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file versions: the state half-way against the state at the end."""
    return store.snapshot_diff(*_snapshots(spark, sf_dir))


@query(
    _SNAPSHOTS
    + """
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'delete' WHEN a.path IS NULL THEN 'parse' WHEN a.size = b.size AND a.mtime_ms = b.mtime_ms THEN 'same' WHEN a.hash = b.hash THEN 'touch' ELSE 'parse' END AS action
FROM old a FULL JOIN new b ON a.path = b.path
"""
)
def change_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch of a stream of changes does with each file: the state half-way is known, that at the end comes in."""
    old, new = _snapshots(spark, sf_dir)
    now = F.current_timestamp().alias("ts")
    come = new.select("path", now, "size", "mtime_ms", "hash")
    gone = old.join(new, "path", "left_anti").select("path", now, "size", "mtime_ms", F.lit(None).cast("string").alias("hash"))
    batch = come.unionByName(gone).withColumns({"lang": F.lit("python"), "text": F.lit(None).cast("string")})
    return upkeep.plan(batch, old).select("path", "action")


@query(_SNAPSHOTS + "SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return old.join(new, "path", "left_anti").select("path")


@query(
    """
SELECT sha256(text) AS hash, count(*) AS files, min(doc_id) AS parsed FROM documents GROUP BY 1
"""
)
def content_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal contents are read once; the others take over its symbols."""
    docs = star.table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("files"), F.min("doc_id").alias("parsed"))


@query(
    """
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id AS path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS changes FROM s GROUP BY user_id, n
"""
)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of changes to a file, apart by more than six hours."""
    events = star.table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return sessions(events, "6 hours").select(
        "path", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "changes"
    )


@query(
    """
WITH refs AS (SELECT event_id AS rid, user_id AS path, event_type AS type, CAST(json_extract(props, '$.k') AS VARCHAR) AS name, value > 50 AS resolved FROM events),
late AS (SELECT user_id AS path FROM events GROUP BY user_id HAVING max(ts) > (SELECT to_timestamp(epoch(max(ts)) - 3600)::TIMESTAMP FROM events))
SELECT rid FROM refs WHERE path IN (SELECT path FROM late) OR name IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation) OR type = 'imports' OR NOT resolved
"""
)
def dirty_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs that a change of some files and names makes stale."""
    refs = star.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("rid"), F.col("user_id").alias("path"), F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("name"), (F.col("value") > 50).alias("resolved")
    )
    names = star.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"))
    # files that changed in the last hour
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    latest = star.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.max(micros).alias("t"))
    changed = latest.join(F.broadcast(latest.agg(F.max("t").alias("end")))).filter("t > `end` - 3600000000").select("path")  # one row
    return store.dirty_refs(refs, changed, names).select("rid")


@query(
    """
SELECT s.s_suppkey AS rid, first(id ORDER BY level, id) AS id FROM supplier s JOIN (
  SELECT n_nationkey AS owner, 1 AS level, 'customer:' || c_custkey AS id, c_mktsegment AS name FROM nation JOIN customer ON c_nationkey = (n_nationkey + 1) % 25
  UNION ALL SELECT n_nationkey, 2, 'customer:' || c_custkey, c_mktsegment FROM nation JOIN customer ON c_nationkey = (n_nationkey + 2) % 25
) m ON m.owner = s_nationkey AND m.name = CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END GROUP BY s_suppkey
"""
)
def inherited_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as types, each based on the next: members are found up to two bases away."""
    refs = star.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("rid"), F.col("s_nationkey").alias("owner"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("name")
    )
    bases = star.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("owner"), ((F.col("n_nationkey") + 1) % 25).alias("base"))
    # of a type's members of one name the first is enough
    members = star.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name")).agg(
        F.min(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))).alias("id")
    )
    return resolve.inherited(refs, bases, members)


@query(
    """
SELECT conv_id, turn, role, CASE WHEN turn = first_value(turn) OVER w THEN 'root' ELSE 'calls' END AS edge, coalesce(lag(turn) OVER w, -1) AS parent FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
"""
)
def turn_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as call chains: each turn and the one before it."""
    turns = star.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = kept(rank.ordinals(turns, ["conv_id"], ["turn", "role", "text"]).drop("text"), "turns")
    before = own.select("conv_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("turn").alias("parent"))
    first = own.groupBy("conv_id").agg(F.min("turn").alias("first"))
    edge = F.when(F.col("turn") == F.col("first"), "root").otherwise("calls")
    return own.join(before, ["conv_id", "ordinal"], "left").join(first, "conv_id").select("conv_id", "turn", "role", edge.alias("edge"), F.coalesce("parent", F.lit(-1)).alias("parent"))
