"""A graph from source files: definitions, imports and calls are extracted, placed and resolved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..extract import about, ddl, lines, nesting
from ..functions.modules import exported_as, file_modules
from ..functions.text import dirname
from ..tables import kept
from . import ladder, store


@dataclass
class Index:
    """The tables of an index; ``edges`` has definitions, imports, supertypes, calls and what asks for tables."""

    nodes: DataFrame
    modules: DataFrame
    packages: DataFrame
    handlers: DataFrame
    imports: DataFrame
    placed: DataFrame
    refs: DataFrame
    bases: DataFrame
    resolved: DataFrame
    edges: DataFrame


def marked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements, and the decorators among them, of lines."""
    whole = kept(about.statements(found), "index-statements")
    return whole, kept(about.decorators(found, whole), "index-decorators")


def nodes_of(files: DataFrame, found: DataFrame | None = None, defs: DataFrame | None = None, routes: DataFrame | None = None, said: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id, path, name, qualified, kind, exported, lang, line_start, line_end, signature and doc of each definition, endpoint and file.

    Equal ids of a file get #2, #3, ...  ``said`` is what ``marked`` gives.
    """
    files = lines.prepared(files)
    found = kept(lines.numbered(files), "index-lines") if found is None else found
    defs = kept(lines.definitions(files, found), "index-definitions") if defs is None else defs
    whole, marks = marked(found) if said is None else said
    routes = kept(about.endpoints(defs, found, marks), "index-routes") if routes is None else routes
    said = kept(about.described(defs, files, found, whole, marks), "index-said")
    whole = defs.join(said, ["path", "line"], "left").withColumn("of", F.col("line"))
    # an endpoint is documented as its handler is
    handled = routes.withColumnRenamed("line", "at").join(said.select("path", F.col("line").alias("of"), "doc"), ["path", "of"], "left")
    handled = handled.select("path", "lang", F.lit("endpoint").alias("kind"), "name", F.col("name").alias("qualified"), F.col("at").alias("line"), F.col("at").alias("line_end"), F.col("name").alias("signature"), "doc")
    own = whole.unionByName(handled, allowMissingColumns=True).withColumn("base", F.concat_ws(":", "path", "kind", "qualified"))
    own = store.numbered_ids(own, ["path", "kind", "qualified"], ["line"], "base", small=True)
    seen = exported_as(F.col("lang"), F.col("kind"), F.col("name"), F.col("signature"), F.col("holder"))
    seen = F.when(F.col("kind") == "endpoint", True).otherwise(F.coalesce(seen, F.lit(True)))
    listed = own.select("id", "path", "name", "qualified", "kind", seen.alias("exported"), "lang", F.col("line").alias("line_start"), "line_end", "signature", "doc")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    last = F.size(F.split("text", "\n"))
    module = files.select(
        F.concat("path", F.lit(":module")).alias("id"), "path", name.alias("name"), name.alias("qualified"), F.lit("module").alias("kind"), F.lit(True).alias("exported"),
        lines.family(F.col("lang")).alias("lang"), F.lit(1).alias("line_start"), last.alias("line_end"), F.lit(None).cast("string").alias("signature"),
    )
    module = module.join(said.filter("line = 0").select("path", "doc"), "path", "left").select(*listed.columns)
    return listed.unionByName(module)


def modules_of(files: DataFrame) -> DataFrame:
    """path, family, module and is_alias of each module that a file has."""
    family = lines.family(F.col("lang"))
    rows = files.select("path", family.alias("family"), F.posexplode(file_modules(family, F.col("path"))).alias("pos", "module"))
    # Java: the package that a file states, and its types in it
    package = F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    java = files.filter("lang = 'java'").select("path", F.lit("java").alias("family"), package.alias("module")).filter("module <> ''").withColumn("is_alias", F.lit(False))
    return rows.select("path", "family", "module", (F.col("pos") > 0).alias("is_alias")).unionByName(java)


def packages_of(files: DataFrame) -> DataFrame:
    """path, package, shared and wide: files of one Go folder, Java package or Swift module.

    Go and Swift packages are one scope; a Swift import opens its whole module.
    """
    family = lines.family(F.col("lang"))
    stated = F.nullif(F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1), F.lit(""))
    name = F.when(family == "go", dirname(F.col("path"))).when(family == "java", stated).when(family == "swift", F.get(file_modules(family, F.col("path")), F.lit(0)))
    rows = files.select("path", F.concat(family, F.lit(":"), name).alias("package"), (family != "java").alias("shared"), (family == "swift").alias("wide"))
    return rows.filter("package IS NOT NULL")


def owned(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (path, line, ...) with ``src_id``: the innermost definition whose block holds their line, or else the file's module."""
    spans = nodes.filter("kind NOT IN ('module', 'endpoint')").select("path", F.col("line_start").alias("line"), "line_end", "id")
    inside = nesting.within(rows, spans, ["id"])
    return inside.withColumn("src_id", F.coalesce(F.try_element_at("around", F.lit(-1))["id"], F.concat("path", F.lit(":module")))).drop("around")


def references_of(files: DataFrame, nodes: DataFrame, found: DataFrame | None = None, defs: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """src_id, path, line, type, name and qualifier: supertypes, calls, tables in texts, and what SQL statements refer to."""
    files = lines.prepared(files)
    found = kept(lines.numbered(files), "index-lines") if found is None else found
    marks = marked(found)[1] if marks is None else marks
    base = F.regexp_extract("base", r"([^.]+)$", 1)
    null = F.lit(None).cast("string")
    bases = lines.supertypes(files, found).select("path", "line", base.alias("name"), F.nullif(F.regexp_extract("base", r"^(.*)\.[^.]*$", 1), F.lit("")).alias("qualifier"), F.lit("inherits").alias("type"))
    called = lines.calls(files, found, defs).select("path", "line", "name", "qualifier", F.lit("calls").alias("type"))
    asked = lines.queries(files).select("path", "line", "name", null.alias("qualifier"), F.lit("queries").alias("type"))
    marks = marks.withColumn("whole", F.regexp_extract("text", r"^\s*@([\w.]+)", 1))
    by_line = nodes.filter("kind NOT IN ('module', 'endpoint')").groupBy("path", F.col("line_start").alias("of")).agg(F.min("id").alias("src_id"))
    marked = marks.join(by_line, ["path", "of"]).select(
        "src_id", "path", "line", F.lit("references").alias("type"), F.substring_index("whole", ".", -1).alias("name"), F.nullif(F.regexp_extract("whole", r"^(.*)\.\w+$", 1), F.lit("")).alias("qualifier")
    )
    placed = owned(bases.unionByName(called).unionByName(asked), nodes)
    # a statement says itself whose it is
    said = ddl.references(files)
    tables = nodes.filter("lang = 'sql' AND kind = 'table'").groupBy("path", F.col("name").alias("owner")).agg(F.min_by("id", "line_start").alias("src_id"))
    stated = said.join(tables, ["path", "owner"], "left").withColumn("src_id", F.coalesce("src_id", F.concat("path", F.lit(":module"))))
    return placed.unionByName(marked).unionByName(stated.select("src_id", "path", "line", "type", "name", null.alias("qualifier")))


def handlers_of(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """src_id (an endpoint), dst_id (what serves it, or says that it is served), path and line."""
    ends = nodes.filter("kind = 'endpoint'").select("path", "name", F.col("line_start").alias("line"), F.col("id").alias("end"))
    at = routes.join(ends, ["path", "name", "line"])
    by_line = nodes.filter("kind NOT IN ('module', 'endpoint')").groupBy("path", F.col("line_start").alias("of")).agg(F.min("id").alias("to"))
    direct = at.filter("of IS NOT NULL").join(by_line, ["path", "of"]).select("end", "to", "path", "line")
    around = owned(at.filter("of IS NULL").select("path", "line", "end"), nodes).select("end", F.col("src_id").alias("to"), "path", "line")
    return direct.unionByName(around).select(F.col("end").alias("src_id"), F.col("to").alias("dst_id"), "path", "line")


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, handlers, imports and references of files with path, lang and text; the latter two without numbers."""
    files = lines.prepared(files)
    found = kept(lines.numbered(files), "index-lines")
    defs = kept(lines.definitions(files, found), "index-definitions")
    said = marked(found)
    routes = kept(about.endpoints(defs, found, said[1]), "index-routes")
    nodes = kept(nodes_of(files, found, defs, routes, said), "index-nodes")
    bound = kept(lines.bindings(files, found).select("path", F.col("lang").alias("family"), "module", "symbol", "alias", "line"), "index-bindings")
    return nodes, kept(handlers_of(routes, nodes), "index-handlers"), bound, kept(references_of(files, nodes, found, defs, said[1]), "index-references")


def numbered_imports(bound: DataFrame, after: int = 0) -> DataFrame:
    made = store.with_rids(bound, ["path"], ["line", "module", "symbol", "alias"], after)
    return made.select("rid", "path", "family", "module", "symbol", "alias", "line")


def numbered_refs(found: DataFrame, after: int = 0) -> DataFrame:
    made = store.with_rids(found, ["path"], ["line", "type", "qualifier", "name"], after)
    return made.select("rid", "src_id", "path", "type", "name", "qualifier", "line")


def bases_of(resolved: DataFrame, refs: DataFrame) -> DataFrame:
    """(owner, base): ids of types and of what they are based on."""
    above = ladder.edges_of(resolved, refs.filter("type = 'inherits'"))
    return above.select(F.col("src_id").alias("owner"), F.col("dst_id").alias("base")).distinct()


def relate(nodes: DataFrame, handlers: DataFrame, imports: DataFrame, placed: DataFrame, refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """The relationships: of resolved references, of endpoints, of placed imports, and of each definition's owner."""
    made = ladder.edges_of(resolved, refs).join(refs.select("rid", "path", "line"), "rid").select("src_id", "dst_id", "type", "confidence", "path", "line")
    module = nodes.filter("kind = 'module'").select("path", F.col("id").alias("src_id"))
    ends = placed.select("rid", "path", F.explode(F.array_compact(F.array("id", "via"))).alias("dst_id")).join(imports.select("rid", "line"), "rid").join(module, "path")
    imported = ends.filter("src_id <> dst_id").select("src_id", "dst_id", F.lit("imports").alias("type"), F.lit("resolved").alias("confidence"), "path", "line")
    owners = nodes.filter("kind <> 'module'").groupBy("path", F.col("qualified").alias("owner")).agg(F.min_by("id", F.struct("line_start", "id")).alias("owner_id"))
    defined = nodes.filter("kind <> 'module'").withColumn("owner", F.when(F.col("kind") != "endpoint", F.regexp_extract("qualified", r"^(.*)\.[^.]*$", 1))).join(owners, ["path", "owner"], "left").join(module, "path")
    defined = defined.select(F.coalesce("owner_id", "src_id").alias("src_id"), F.col("id").alias("dst_id"), F.lit("defines").alias("type"), F.lit("exact").alias("confidence"), "path", F.col("line_start").alias("line"))
    served = handlers.select("src_id", "dst_id", F.lit("references").alias("type"), F.lit("exact").alias("confidence"), "path", "line")
    return store.upsert(made.unionByName(imported).unionByName(defined).unionByName(served), ["src_id", "dst_id", "type"], [-F.col("line")])


def build(files: DataFrame, linked: DataFrame | None = None) -> Index:
    """The index of files with path, lang and text.

    Supertypes are resolved first, so that members can be looked for on them; then calls.
    """
    files = lines.prepared(files)
    nodes, handlers, bound, found = extract(files)
    imports = kept(numbered_imports(bound), "index-imports")
    modules, packages = kept(modules_of(files), "index-modules"), kept(packages_of(files), "index-packages")
    placed = kept(ladder.place_imports(imports, modules, nodes), "index-placed")
    refs = kept(numbered_refs(found), "index-refs")
    none = nodes.sparkSession.createDataFrame([], "owner string, base string")
    first, second = refs.filter("type = 'inherits'"), refs.filter("type <> 'inherits'")
    supers = kept(ladder.resolve(first, nodes, placed, none, linked, packages=packages), "index-supertypes")
    bases = kept(bases_of(supers, refs), "index-bases")
    resolved = kept(supers.unionByName(ladder.resolve(second, nodes, placed, bases, linked, packages=packages)), "index-resolved")
    return Index(nodes, modules, packages, handlers, imports, placed, refs, bases, resolved, relate(nodes, handlers, imports, placed, refs, resolved))
