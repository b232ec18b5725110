"""SQL files: statements, the tables and routines that they declare, and what these refer to.

Comments and texts are blanked first, delimited names aren't.  A statement is a session of the pieces between
semicolons: it goes on while parentheses are open, which is a running sum over the pieces of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bare_identifier, tables_in_text
from . import nesting

_NAME = r"((?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])(?:\s*\.\s*(?:[\w$]+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\]))*)"
_MAYBE = r"(?:if\s+not\s+exists\s+)?"
TABLE = rf"(?is)^create\s+(?:or\s+replace\s+)?(?:(?:global|local)\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?table\s+{_MAYBE}{_NAME}"
VIEW = rf"(?is)^create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?view\s+{_MAYBE}{_NAME}"
ROUTINE = rf"(?is)^create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+{_NAME}"
ALTER = rf"(?is)^alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{_NAME}"
INDEX = rf"(?is)^create\s+(?:unique\s+)?index\b[^(]*?\bon\s+(?:only\s+)?{_NAME}"
REFERENCE = rf"(?is)(.*?)\breferences\s+{_NAME}"


def _breaks(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\n]", ""))


def statements(files: DataFrame) -> DataFrame:
    """path, line, line_end and text of each statement, from its first word on."""
    code = nesting.masked(files.filter("lang = 'sql'")).select("path", F.posexplode(F.split("code", ";")).alias("k", "piece"))
    order = Window.partitionBy("path").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    depth = F.length(F.regexp_replace("piece", r"[^(]", "")) - F.length(F.regexp_replace("piece", r"[^)]", ""))
    placed = code.withColumns({"at": F.coalesce(F.sum(_breaks(F.col("piece"))).over(before), F.lit(0)), "open": F.coalesce(F.sum(depth).over(before), F.lit(0))})
    placed = placed.withColumn("statement", F.sum(F.when(F.col("open") <= 0, 1).otherwise(0)).over(order))
    whole = placed.groupBy("path", "statement").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["piece"]), ";")
    lead = F.regexp_extract("text", r"^(\s*)", 1)
    return whole.withColumn("text", text).filter("trim(regexp_replace(text, '\\\\s', '')) <> ''").select(
        "path", (F.col("at") + _breaks(lead) + 1).alias("line"), (F.col("at") + _breaks(F.rtrim(F.regexp_replace("text", r"\s+$", ""))) + 1).alias("line_end"),
        F.regexp_replace("text", r"^\s+", "").alias("text"),
    )


def _named(pattern: str) -> Column:
    return F.nullif(bare_identifier(F.regexp_extract("text", pattern, 1)), F.lit(""))


def declared(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """path, kind, name, line and line_end of each table, view (a table too) and routine."""
    rows = statements(files) if found is None else found
    table, routine = F.coalesce(_named(TABLE), _named(VIEW)), _named(ROUTINE)
    rows = rows.withColumns({"name": F.coalesce(table, routine), "kind": F.when(table.isNotNull(), "table").otherwise("function")})
    return rows.filter("name IS NOT NULL").select("path", "kind", "name", "line", "line_end")


def references(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """path, line, type, name and owner: what statements refer to.

    Foreign keys of a table are its own, those of an ALTER the altered table's, if its file declares it; an index
    refers to its table for the file.  ``owner`` is a name, or null for the file.  A view asks for tables.
    """
    rows = statements(files) if found is None else found
    table, view, alter, index = (_named(p) for p in (TABLE, VIEW, ALTER, INDEX))
    rows = rows.withColumns({"table": table, "view": view, "alter": alter, "index": index})
    keys = rows.filter("table IS NOT NULL OR alter IS NOT NULL")
    ahead = F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1))
    to = F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(2))
    lines = F.transform(F.sequence(F.lit(1), F.size(ahead)), lambda i: _breaks(F.array_join(F.slice(ahead, F.lit(1), i), " ")))
    keys = keys.filter(F.size(to) > 0).select("path", "line", F.coalesce("table", "alter").alias("owner"), F.explode(F.arrays_zip(to.alias("to"), lines.alias("down"))).alias("r"))
    keys = keys.select("path", (F.col("line") + F.col("r.down")).alias("line"), F.lit("references").alias("type"), bare_identifier(F.col("r.to")).alias("name"), "owner")
    null = F.lit(None).cast("string")
    indexed = rows.filter("table IS NULL AND view IS NULL AND alter IS NULL AND index IS NOT NULL").select("path", "line", F.lit("references").alias("type"), F.col("index").alias("name"), null.alias("owner"))
    body = F.regexp_replace("text", VIEW, "")
    asked = rows.filter("table IS NULL AND view IS NOT NULL").select("path", "line", F.lit("queries").alias("type"), F.explode(tables_in_text(body)).alias("name"), F.col("view").alias("owner"))
    return keys.unionByName(indexed).unionByName(asked)
