"""Definitions, imports and calls of source files, by line patterns for each language.

Patterns, one alternation for each language and kind, run as columns over the lines of a file, from which
comments and texts are blanked; ``nesting`` says where definitions end and what they are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import looks_like_sql, tables_in_text
from ..tables import kept
from . import ddl, nesting

# For each language, (kind, pattern with the name in the first group).
DEFINITIONS = {
    "python": (("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("constant", r"^([A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=")),
    "go": (("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("struct", r"^type\s+(\w+)\b"), ("constant", r"^(?:const|var)\s+([A-Z]\w*)")),
    "typescript": (("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|enum)\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?(?:interface|type)\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("constant", r"^\s*(?:export\s+)?const\s+([A-Z][A-Z0-9_]+)\s*[:=]")),
    "java": (("class", r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|enum)\s+(\w+)"), ("interface", r"^\s*(?:(?:public|protected|private|static)\s+)*@?interface\s+(\w+)"), ("struct", r"^\s*(?:(?:public|protected|private|static|final)\s+)*record\s+(\w+)"), ("constant", r"^\s*(?:(?:public|protected|private)\s+)?static\s+final\s+[\w<>\[\], ]+\s(\w+)\s*=")),
    "swift": (("extension", r"^\s*(?:@\w+\s+)*(?:(?:public|internal|private|fileprivate)\s+)*extension\s+([\w.]+)"), ("class", r"^\s*(?:(?:public|open|internal|private|fileprivate|final|indirect)\s+)*(?:class|actor|enum)\s+(?!func\b|var\b)(\w+)"), ("struct", r"^\s*(?:(?:public|internal|private|fileprivate)\s+)*struct\s+(\w+)"), ("interface", r"^\s*(?:(?:public|internal|private|fileprivate)\s+)*(?:protocol|typealias)\s+(\w+)"), ("function", r"^\s*(?:@\w+\s+)*(?:(?:public|open|internal|private|fileprivate|static|class|override|mutating|final)\s+)*func\s+(\w+)")),
}
# Members that no word announces; they count directly inside a type only.
MEMBERS = {
    "typescript": r"^\s*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*[*#]?(\w+)\??\s*(?:<[^>()]*>)?\(",
    "java": r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>()]*>\s+)?(?:[\w.]+(?:<[^()]*>)?(?:\[\])*\s+)?(\w+)\s*\(",
    "swift": r"^\s*(?:(?:public|internal|private|fileprivate|override|required|convenience)\s+)*(init|deinit|subscript)\b[?!]?\s*[({<]",
    "go": r"^\s+([A-Z]\w*)\s*\([^)]*\)",
}
IMPORTS = {
    "python": r"^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))",
    "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$",
    "typescript": r"(?:^\s*(?:import|export)\b[^'\"]*|\brequire\(\s*)['\"]([^'\"]+)['\"]",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
    "swift": r"^\s*(?:@testable\s+)?import\s+(\w+)",
}
# Words before a parenthesis that aren't calls.
_NO_CALL = ("if", "for", "while", "switch", "catch", "return", "function", "func", "def", "class", "and", "or", "not", "in", "elif", "with", "guard", "await", "super", "new", "sizeof", "typeof")


def family(lang: Column) -> Column:
    """tsx and javascript are read as typescript is."""
    return F.when(lang.isin("tsx", "javascript"), F.lit("typescript")).otherwise(lang)


def prepared(files: DataFrame) -> DataFrame:
    """Files with path, lang and text, cut into pieces once for all that is read from them, and dealt by path."""
    if "pieces" in files.columns:
        return files
    rows = kept(files.select("path", family(F.col("lang")).alias("lang"), "text"), "texts", "path")
    return kept(nesting.cut(rows), "pieces")


def numbered(files: DataFrame) -> DataFrame:
    """The lines of files that have code, as ``nesting.measured`` gives them; ``text`` has its literals of one line too."""
    rows = files.withColumn("lang", family(F.col("lang")))
    return nesting.measured(rows).withColumnRenamed("said", "text")


def definitions(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """path, lang, kind, name, qualified, owner and holder (name and kind of its type), receiver, line and line_end of each definition.

    Of several patterns that fit the first counts.  A name is qualified by all that it is in, a Go method by
    its receiver.  What is directly in a type is a method, and in Python whatever has a class around it.
    ``lines`` are those of ``numbered``, if they are kept already.
    """
    lines = kept(numbered(files), "lines") if lines is None else lines
    found, member = None, F.lit(None).cast("string")
    for lang, patterns in DEFINITIONS.items():
        for kind, pattern in reversed(patterns):
            name = F.regexp_extract("code", pattern, 1)
            hit = (F.col("lang") == lang) & (name != "")
            one = F.struct(F.lit(kind).alias("kind"), name.alias("name"))
            found = F.when(hit, one) if found is None else F.when(hit, one).otherwise(found)
    for lang, pattern in MEMBERS.items():
        member = F.when(F.col("lang") == lang, F.nullif(F.regexp_extract("code", pattern, 1), F.lit(""))).otherwise(member)
    rows = lines.filter("lang <> 'sql' AND NOT inside").drop("closes", "text").withColumns({"d": found, "member": member})
    rows = kept(rows, "patterns")  # else each filter below tries all patterns again
    known = rows.filter("d IS NOT NULL").withColumns({"kind": F.col("d.kind"), "name": F.col("d.name")}).drop("d", "member")
    types = kept(nesting.spans(known.filter(F.col("kind").isin(*nesting.TYPES)), lines), "types")
    bare = rows.filter("d IS NULL").withColumnRenamed("member", "name").filter(F.col("name").isNotNull() & ~F.col("name").isin(*_NO_CALL))
    held = nesting.within(bare.drop("d"), types, ["name", "level", "kind"]).withColumn("type", F.try_element_at("around", F.lit(-1)))
    typed = F.col("code").rlike(r"[\w>\]]\s+\w+\s*\(") | (F.col("type.name") == F.col("name")) | (F.col("lang") != "java")
    fits = (F.col("level") == F.col("type.level") + 1) & typed & ((F.col("lang") != "go") | (F.col("type.kind") == "interface"))
    members = held.filter(fits).drop("around", "type").withColumn("kind", F.lit("method"))
    all_ = nesting.spans(known.unionByName(members), lines).select("path", "lang", "kind", "name", "line", "line_end", "code")
    all_ = kept(all_, "definitions")
    deep = nesting.within(all_.withColumn("starts", F.lit(True)), all_, ["name", "kind"])
    is_type = lambda x: x["kind"].isin(*nesting.TYPES)
    direct = F.coalesce(is_type(F.try_element_at("around", F.lit(-1))), F.lit(False))
    in_type = F.when(F.col("lang") == "python", F.exists("around", is_type)).otherwise(direct)
    receiver = F.when(F.col("lang") == "go", F.nullif(F.regexp_extract("code", r"^func\s+\(\s*\w*\s*\*?\s*(\w+)", 1), F.lit("")))
    deep = deep.withColumn("receiver", receiver)
    owner = F.try_element_at(F.transform(F.filter("around", is_type), lambda x: x["name"]), F.lit(-1))
    holder = F.try_element_at(F.transform(F.filter("around", is_type), lambda x: x["kind"]), F.lit(-1))
    prefix = F.when(F.col("receiver").isNotNull(), F.array("receiver")).otherwise(F.transform("around", lambda x: x["name"]))
    # an extension names the type of its members, and is no symbol itself
    deep = deep.filter("kind <> 'extension'")
    local = (F.col("kind") == "constant") & F.exists("around", lambda x: ~is_type(x))  # no other file can mean it
    made = deep.filter(~local).select(
        "path", "lang", F.when((F.col("kind") == "function") & in_type, "method").otherwise(F.col("kind")).alias("kind"), "name",
        F.array_join(F.concat(prefix, F.array("name")), ".").alias("qualified"), F.coalesce("receiver", owner).alias("owner"), holder.alias("holder"), "receiver", "line", "line_end",
    )
    null = F.lit(None).cast("string")
    named = ddl.declared(files).select("path", F.lit("sql").alias("lang"), "kind", "name", F.col("name").alias("qualified"), null.alias("owner"), null.alias("holder"), null.alias("receiver"), "line", "line_end")
    return made.unionByName(named)


def _statements(lines: DataFrame) -> DataFrame:
    """Lines, those of an import that goes over several joined: path, lang, line and text."""
    opens = r"^\s*(?:from\s+[.\w]+\s+import\b|import\b|export\s+(?:type\s+)?\{)"
    begins = F.when(F.col("lang") == "python", ~F.col("inside")).when(F.col("lang") == "typescript", (F.col("level") == 0) | F.col("text").rlike(r"\brequire\(")).otherwise(F.lit(True))
    order = Window.partitionBy("path").orderBy("line")
    numbered_ = lines.withColumn("statement", F.sum(begins.cast("int")).over(order))
    head = F.first("text").over(Window.partitionBy("path", "statement").orderBy("line"))
    goes_on = F.col("head").rlike(opens) & ~(F.col("lang").isin("go", "swift", "java"))
    rows = numbered_.withColumn("head", head)
    alone = rows.filter(~goes_on).select("path", "lang", "line", "text")
    joined = rows.filter(goes_on).groupBy("path", "lang", "statement").agg(F.min("line").alias("line"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("parts"))
    return alone.unionByName(joined.select("path", "lang", "line", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text")))


def imports(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """path, lang, module and line of each import."""
    found = None
    for lang, pattern in IMPORTS.items():
        groups = [F.nullif(F.regexp_extract("text", pattern, k), F.lit("")) for k in range(1, 3 if lang == "python" else 2)]
        one = F.when(F.col("lang") == lang, F.coalesce(*groups) if len(groups) > 1 else groups[0])
        found = one if found is None else F.coalesce(found, one)
    lines = numbered(files) if lines is None else lines
    return _statements(lines).withColumn("module", found).filter("module IS NOT NULL").select("path", "lang", "module", "line")


_CLAUSE = r"^\s*(?:import|export)\s+(?:type\s+)?(.*?)\s*\bfrom\s*['\"]([^'\"]+)['\"]"
_REQUIRED = r"(?:const|let|var)\s+(\w+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]"
_BINDING = "array<struct<module:string,symbol:string,alias:string>>"


def bindings(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """path, lang, line, module, symbol and alias of each name that an import binds.

    Whole modules have no symbol, and no alias either if all of their names are taken over; ``default`` is the
    symbol of a default import.  An import that binds nothing has an empty alias.
    """
    t, null = F.col("text"), F.lit(None).cast("string")
    got = lambda pattern, k, text=t: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    one = lambda module, symbol, alias: F.struct(module.alias("module"), symbol.alias("symbol"), alias.alias("alias"))
    listed = lambda text: F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[\w.*]"))
    renamed = lambda x: F.coalesce(got(r"\bas\s+(\w+)", 1, x), got(r"^([\w.]+)", 1, x))

    from_, plain = r"^\s*from\s+([.\w]+)\s+import\s+\(?([^#()]*)", r"^\s*import\s+([\w.][^#]*)"
    python = F.when(
        t.rlike(from_),
        F.transform(listed(F.regexp_extract(t, from_, 2)), lambda x: F.when(x == "*", one(got(from_, 1), null, null)).otherwise(one(got(from_, 1), got(r"^(\w+)", 1, x), renamed(x)))),
    ).when(t.rlike(plain), F.transform(listed(F.regexp_extract(t, plain, 1)), lambda x: one(got(r"^([\w.]+)", 1, x), null, renamed(x))))
    clause, source = F.regexp_extract(t, _CLAUSE, 1), got(_CLAUSE, 2)
    named = F.transform(listed(F.regexp_extract(clause, r"\{([^}]*)\}?", 1)), lambda x: one(source, got(r"^(?:type\s+)?(\w+)", 1, x), renamed(F.regexp_replace(x, r"^type\s+", ""))))
    whole = F.when(clause.rlike(r"\*\s*as\s+\w+"), F.array(one(source, null, got(r"\*\s*as\s+(\w+)", 1, clause)))).when(clause.rlike(r"^\*"), F.array(one(source, null, null)))
    default = F.when(clause.rlike(r"^\w"), F.array(one(source, F.lit("default"), got(r"^(\w+)", 1, clause))))
    none = F.array().cast(_BINDING)
    effect = r"^\s*import\s*['\"]([^'\"]+)['\"]"
    typescript = (
        F.when(t.rlike(_CLAUSE), F.concat(*[F.coalesce(x.cast(_BINDING), none) for x in (default, whole, named)]))
        .when(t.rlike(_REQUIRED), F.array(one(got(_REQUIRED, 2), null, got(_REQUIRED, 1))))
        .when(t.rlike(effect), F.array(one(got(effect, 1), null, F.lit(""))))
    )
    type_ = r"^\s*import\s+(?:static\s+)?([\w.]+)\.(\w+|\*)\s*;"
    name = F.when(got(type_, 2) != "*", got(type_, 2))
    java = F.when(t.rlike(type_), F.array(one(got(type_, 1), name, name)))
    package = r"^\s*(?:import\s+)?(?:([\w.]+)\s+)?\"([^\"]+)\"\s*$"
    go = F.when(t.rlike(package), F.array(one(got(package, 2), null, F.coalesce(got(package, 1), F.substring_index(got(package, 2), "/", -1)))))
    swift = F.when(t.rlike(IMPORTS["swift"]), F.array(one(got(IMPORTS["swift"], 1), null, got(IMPORTS["swift"], 1))))
    found = None
    for lang, value in (("python", python), ("typescript", typescript), ("java", java), ("go", go), ("swift", swift)):
        found = F.when(F.col("lang") == lang, value.cast(_BINDING)) if found is None else found.when(F.col("lang") == lang, value.cast(_BINDING))
    rows = _statements(numbered(files) if lines is None else lines).withColumn("bound", found).filter("bound IS NOT NULL")
    return rows.select("path", "lang", "line", F.explode("bound").alias("b")).select("path", "lang", "line", "b.*").filter("module IS NOT NULL")


def supertypes(files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """path, lang, line and base of each type that a class line names after its own."""
    t = F.col("text")
    after = (
        F.when(F.col("lang") == "python", F.regexp_extract(t, r"^\s*class\s+\w+\s*\(([^)]*)\)", 1))
        .when(F.col("lang").isin("typescript", "java"), F.regexp_replace(F.regexp_extract(t, r"\b(?:class|interface|record)\s+\w+[^{]*?\b((?:extends|implements)\b[^{]*)", 1), r"\b(?:extends|implements)\b", ","))
        .when(F.col("lang") == "swift", F.regexp_extract(t, r"^\s*(?:\w+\s+)*(?:class|struct|enum|actor|protocol)\s+\w+(?:<[^>]*>)?\s*:\s*([^{]*)", 1))
        .otherwise("")
    )
    names = F.filter(F.transform(F.split(F.regexp_replace(after, r"<[^>]*>", ""), ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z_][\w.]*$"))
    lines = numbered(files) if lines is None else lines
    return lines.select("path", "lang", "line", F.explode(names).alias("base"))


def calls(files: DataFrame, lines: DataFrame | None = None, defs: DataFrame | None = None) -> DataFrame:
    """path, lang, qualifier (null for a bare call), name and line of each call; a definition's own name isn't one."""
    lines = numbered(files) if lines is None else lines
    defs = definitions(files, lines) if defs is None else defs
    hits = F.regexp_extract_all("code", F.lit(r"((?:\w+\.)*\w+)\s*\("), F.lit(1))
    # decorators are references of what they decorate
    named = lines.filter((F.col("lang") != "sql") & ~F.col("code").rlike(r"^\s*@\w")).select("path", "lang", "line", F.posexplode(hits).alias("place", "whole"))
    before = F.regexp_extract("whole", r"^(.*)\.\w+$", 1)
    found = named.select("path", "lang", "line", "place", F.nullif(before, F.lit("")).alias("qualifier"), F.substring_index("whole", ".", -1).alias("name"))
    found = found.filter(~F.col("name").isin(*_NO_CALL))
    # the first time that a line says the name it defines is the definition
    order = Window.partitionBy("path", "line", "name").orderBy("place")
    first = found.withColumn("turn", F.row_number().over(order))
    own = defs.select("path", "line", "name").distinct().withColumn("turn", F.lit(1))
    return first.join(own, ["path", "line", "name", "turn"], "left_anti").select("path", "lang", "qualifier", "name", "line")


def queries(files: DataFrame) -> DataFrame:
    """path, line and name of each table that a literal of a file asks for, SQL files apart."""
    rows = files.withColumn("lang", family(F.col("lang"))).filter("lang <> 'sql'")
    said = nesting.literals(rows).filter(looks_like_sql(F.col("text")))
    return said.select("path", "line", F.explode(tables_in_text(F.col("text"))).alias("name"))
