"""Queries over what is extracted from source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..extract import about, lines
from ..operators import index
from ..sources import texts
from ..tables import kept

QUERIES, ORACLES = {}, {}


def query(sql: str, known: str = texts.SQL):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, known + sql
        return f

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.prepared(texts.files(spark, sf_dir))


@query("SELECT path || ':' || kind || ':' || qualified AS id, path, kind, qualified, line_start, line_end FROM defs")
def index_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with their blocks: nested, over several lines, directly in types, and in SQL statements."""
    nodes = index.nodes_of(_files(spark, sf_dir)).filter("kind <> 'module'")
    return nodes.select("id", "path", "kind", "qualified", "line_start", "line_end")


@query("SELECT path || owner AS src_id, type, name, qualifier, line FROM refs")
def refs_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each definition, or else the file, refers to: supertypes, calls, tables in texts and in statements."""
    files = _files(spark, sf_dir)
    nodes, _, _, found = index.extract(files)
    return found.select("src_id", "type", "name", "qualifier", "line")


@query(
    """
SELECT src_id, dst_id, type, confidence FROM (
  SELECT r.path || r.owner AS src_id, d.path || ':' || d.kind || ':' || d.qualified AS dst_id, r.type, CASE WHEN r.qualifier IS NOT NULL THEN NULL WHEN r.type = 'queries' THEN 'resolved' ELSE 'exact' END AS confidence
  FROM refs r JOIN defs d ON d.path = r.path AND d.qualified = r.name AND (r.type <> 'queries' OR d.kind = 'table')
) WHERE confidence IS NOT NULL
UNION ALL SELECT path || ':function:run_' || k, path || ':method:C' || k || '.open', 'calls', 'resolved' FROM f WHERE NOT py
UNION ALL SELECT path || CASE WHEN contains(qualified, '.') THEN CASE WHEN starts_with(qualified, 'top') THEN ':function:' ELSE ':class:' END || split_part(qualified, '.', 1) ELSE ':module' END, path || ':' || kind || ':' || qualified, 'defines', 'exact' FROM defs
"""
)
def index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relationships of a whole index: each file's own calls, and what it defines."""
    made = index.build(texts.files(spark, sf_dir))
    return made.edges.select("src_id", "dst_id", "type", "confidence")


@query("SELECT id, signature, doc, exported FROM about", texts.WEB_SQL)
def symbol_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures over several lines, docstrings, comments above decorators, and visibility."""
    nodes = index.nodes_of(texts.web_files(spark, sf_dir))
    return nodes.select("id", "signature", "doc", "exported")


@query("SELECT id AS endpoint, handler FROM about WHERE handler IS NOT NULL", texts.WEB_SQL)
def endpoint_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with the prefix of their type, and what serves them."""
    files = lines.prepared(texts.web_files(spark, sf_dir))
    found = kept(lines.numbered(files), "lines")
    defs = kept(lines.definitions(files, found), "definitions")
    routes = kept(about.endpoints(defs, found), "routes")
    nodes = kept(index.nodes_of(files, found, defs, routes), "index-nodes")
    return index.handlers_of(routes, nodes).selectExpr("src_id AS endpoint", "dst_id AS handler")
