"""What is said about definitions: comments above them, docstrings in them, signatures, decorators and endpoints.

A comment block is an island of consecutive comment lines; it belongs to the definition that it touches, or whose
decorators it touches.  A decorator belongs to the next line that isn't one, which is a window over the lines of a
file that looks ahead.  A statement is the lines from one without open parentheses to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_doc, first_paragraph, join_route, squash, truncate
from . import nesting

MAX_SIGNATURE = 200
# Names of decorators and methods that declare a route; of these, those that take any verb.
PYTHON_ROUTES = ("route", "get", "post", "put", "patch", "delete", "head", "options", "websocket")
ROUTES = ("get", "post", "put", "patch", "delete", "all", "use")
ANY_VERB = ("all", "use")
SPRING = ("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping")


def statements(lines: DataFrame) -> DataFrame:
    """path, lang, line, end, code and text of each statement."""
    order = Window.partitionBy("path").orderBy("line")
    numbered = lines.withColumn("statement", F.sum((~F.col("inside")).cast("int")).over(order))
    whole = numbered.groupBy("path", "lang", "statement").agg(F.min("line").alias("line"), F.max("line").alias("end"), F.sort_array(F.collect_list(F.struct("line", "code", "text"))).alias("parts"))
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), " ")
    return whole.select("path", "lang", "line", "end", joined("code").alias("code"), joined("text").alias("text"))


def _signature(lang: Column, text: Column) -> Column:
    """A definition's statement up to its body."""
    head = F.when(lang == "python", F.regexp_replace(text, r":[^:]*$", "")).otherwise(F.regexp_extract(text, r"^([^{]*)", 1))
    return truncate(F.regexp_replace(squash(head), r"[\s{:=>;]+$", ""), MAX_SIGNATURE)


def comments(files: DataFrame) -> DataFrame:
    """path, line, end and text of each block of lines that are comments only."""
    split = lambda c: F.split(c, r"\r?\n")
    rows = nesting.masked(files).select("path", F.posexplode(F.arrays_zip(split("code").alias("code"), split("notes").alias("note"))).alias("k", "l"))
    only = rows.filter("trim(l.note) <> '' AND trim(l.code) = ''").select("path", (F.col("k") + 1).alias("line"), F.col("l.note").alias("note"))
    island = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    blocks = only.withColumn("island", island).groupBy("path", "island").agg(F.min("line").alias("line"), F.max("line").alias("end"), F.sort_array(F.collect_list(F.struct("line", "note"))).alias("parts"))
    return blocks.select("path", "line", "end", F.array_join(F.transform("parts", lambda p: F.trim(p["note"])), "\n").alias("text"))


def decorators(lines: DataFrame, found: DataFrame) -> DataFrame:
    """path, lang, line, text and of, the line of what it decorates, of each decorator or annotation on lines of its own."""
    is_one = found["code"].rlike(r"^\s*@(?!interface\b)[\w.]+\s*(\(.*\))?\s*$")
    order = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("one", is_one).withColumn("of", F.last(F.when(~F.col("one"), F.col("line")), True).over(order))
    return placed.filter("one AND of IS NOT NULL").select("path", "lang", "line", "text", "of")


def described(defs: DataFrame, files: DataFrame, lines: DataFrame, whole: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """(path, line, signature, doc) of definitions, and of files, whose line is 0; ``whole`` and ``marks`` are statements and decorators, if they are kept already."""
    whole = statements(lines) if whole is None else whole
    marks = decorators(lines, whole) if marks is None else marks
    own = defs.select("path", "lang", "line").distinct()
    heads = own.join(whole.drop("lang"), ["path", "line"]).select("path", "lang", "line", "end", _signature(F.col("lang"), F.col("text")).alias("signature"))
    tops = marks.groupBy("path", F.col("of").alias("line")).agg(F.min("line").alias("top"))
    heads = heads.join(tops, ["path", "line"], "left").withColumn("top", F.coalesce("top", "line"))
    above = comments(files).select("path", (F.col("end") + 1).alias("top"), F.col("text").alias("above"))
    heads = heads.join(above, ["path", "top"], "left")
    # the first literal after a head is a docstring if no code comes before it
    said = nesting.literals(files.filter("lang = 'python'")).select("path", "line", F.lit(1).alias("turn"), "text")
    code = lines.filter("lang = 'python' AND trim(code) <> ''").select("path", "line", F.lit(0).alias("turn"), F.lit(True).alias("is_code"))
    asks = heads.filter("lang = 'python'").select("path", F.col("end").alias("line"), F.lit(2).alias("turn"), F.col("line").alias("of"))
    asks = asks.unionByName(files.filter("lang = 'python'").select("path", F.lit(0).alias("line"), F.lit(2).alias("turn"), F.lit(0).alias("of")))
    events = said.unionByName(code, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True)
    ahead = Window.partitionBy("path").orderBy(F.desc("line"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    next_ = F.last(F.when(F.col("of").isNull(), F.struct("text", "is_code")), True).over(ahead)
    strings = events.withColumn("next", next_).filter("of IS NOT NULL AND next.is_code IS NULL").select("path", F.col("of").alias("line"), F.col("next.text").alias("inside"))
    both = heads.join(strings, ["path", "line"], "left").select("path", "line", "signature", first_paragraph(F.coalesce("inside", clean_doc(F.when(F.col("lang") != "python", F.col("above"))))).alias("doc"))
    modules = strings.filter("line = 0").select("path", "line", F.lit(None).cast("string").alias("signature"), first_paragraph(F.col("inside")).alias("doc"))
    return both.unionByName(modules)


def endpoints(defs: DataFrame, lines: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """path, lang, line, name and of: routes, and the line of the definition that serves each; null where a call declares one.

    A Spring route stands behind that of its type; several paths of one handler count as the first.
    """
    got = lambda pattern, k=1: F.regexp_extract("text", pattern, k)
    found = decorators(lines, statements(lines)) if marks is None else marks
    python = found.filter("lang = 'python'").withColumns({"name": got(r"^\s*@(?:\w+\.)*(\w+)\s*\("), "route": got(r"\(\s*[rRuUbBfF]{0,2}[\"'](/[^\"']*)[\"']")})
    python = python.filter(F.lower("name").isin(*PYTHON_ROUTES) & (F.col("route") != ""))
    verbs = F.regexp_extract_all(got(r"\bmethods\s*=\s*[\[(]([^\])]*)"), F.lit(r"[\"'](\w+)[\"']"), F.lit(1))
    verb = F.when(F.lower("name") != "route", F.upper("name")).otherwise(F.when(F.size(verbs) > 0, F.upper(F.array_join(verbs, "|"))).otherwise("ANY"))
    routes = python.join(defs.filter("kind IN ('function', 'method')").select("path", F.col("line").alias("of")), ["path", "of"], "left_semi")
    routes = routes.select("path", "lang", "line", F.concat(verb, F.lit(" "), F.trim("route")).alias("name"), "of")

    mapped = found.filter("lang = 'java'").withColumn("name", got(r"^\s*@(\w+)")).filter(F.col("name").isin(*SPRING))
    keyed = got(r"[(,]\s*(?:value|path)\s*=\s*\{?\s*\"([^\"]*)\"")
    mapped = mapped.withColumn("route", F.when(keyed != "", keyed).otherwise(got(r"\(\s*\{?\s*\"([^\"]*)\"")))
    methods = F.regexp_extract_all("text", F.lit(r"RequestMethod\.(\w+)"), F.lit(1))
    mapped = mapped.withColumn("verb", F.when(F.col("name") != "RequestMapping", F.upper(F.regexp_replace("name", "Mapping$", ""))).otherwise(F.when(F.size(methods) > 0, F.array_join(methods, "|")).otherwise("ANY")))
    types = defs.filter(F.col("kind").isin(*nesting.TYPES)).select("path", "line", "line_end")
    prefix = mapped.filter("name = 'RequestMapping'").groupBy("path", F.col("of").alias("type")).agg(F.min_by("route", "line").alias("prefix"))
    served = mapped.join(defs.filter("kind = 'method'").select("path", F.col("line").alias("of")), ["path", "of"], "left_semi")
    placed = nesting.within(served.drop("name"), types, ["line"]).withColumn("type", F.try_element_at("around", F.lit(-1))["line"])
    java = placed.join(prefix, ["path", "type"], "left").select("path", "lang", "line", F.concat("verb", F.lit(" "), join_route(F.coalesce("prefix", F.lit("")), F.col("route"))).alias("name"), "of")

    calls = r"\.(?:" + "|".join(ROUTES) + r")\s*\(\s*[\"']/[^\"']*[\"']"
    said = lines.filter("lang = 'typescript'").select("path", "lang", "line", F.explode(F.regexp_extract_all("text", F.lit(calls), F.lit(0))).alias("text"))
    method = got(r"^\.(\w+)")
    called = said.select("path", "lang", "line", F.concat(F.when(method.isin(*ANY_VERB), "ANY").otherwise(F.upper(method)), F.lit(" "), got(r"[\"'](/[^\"']*)[\"']")).alias("name"), F.lit(None).cast("int").alias("of"))
    return routes.unionByName(java).unionByName(called)
