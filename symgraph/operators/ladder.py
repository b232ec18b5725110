"""The whole ladder that turns references into relationships, and the placement of imports that it needs.

All rungs are equality joins.  Names are counted before they are joined, so a name that is everywhere never
meets all of its references; what a reference can still meet is bounded by ``most``.  Rungs say for
themselves which references they apply to, and of a reference's rungs the first that has a target counts.

Tables: refs (rid, src_id, path, type, name, qualifier), nodes (id, path, name, qualified, kind, exported),
imports (rid, path, family, module, symbol, alias), modules (path, family, module, is_alias), bases
(owner, base; ids of types).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.modules import candidates, never_local, submodule
from ..schemas import KIND_PRIORITY, rank_in
from ..tables import kept
from .resolve import MOST, first_hit

# Receivers that mean the enclosing type, and kinds that are types.
SELVES = ("self", "this", "cls")
TYPES = ("class", "struct", "interface")
HOPS = 4
RUNGS = ("tables", "self", "same_file", "swift_member", "imported", "receiver", "local_type", "visible", "qualified", "global", "linked")
_ROW = "rid bigint, id string, rung int, confidence string"


def _order() -> Column:
    return F.struct(rank_in(KIND_PRIORITY, "kind"), ~F.col("exported"), "path", "id")


def _best(defs: DataFrame, *by: str) -> DataFrame:
    return defs.groupBy(*by).agg(F.min_by("id", _order()).alias("id"), F.count("*").alias("n"))


def target_files(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(rid, file): the file that an import's module means, if it is in the tree."""
    own = imports.filter(F.col("module").isNotNull() & ~never_local(F.col("family"), F.col("module")))
    tried = own.select("rid", "path", "family", candidates(F.col("family"), F.col("module"), F.col("path")).alias("candidates"))
    return first_hit(tried, modules).withColumnRenamed("path", "file")


def exported_symbols(wanted: DataFrame, imports: DataFrame, defs: DataFrame, hops: int = HOPS) -> DataFrame:
    """(file, symbol, id) for each (file, symbol): its definition, there or in what the file passes on.

    A file passes on what it imports under that name, and all of what it imports whole without a name.  The
    search goes level by level, a file and name once from each start; of a level the first in the order of
    imports counts.  ``imports`` has rid, path, symbol, alias and file, its target.
    """
    here = kept(_best(defs, "path", "name").select(F.col("path").alias("at"), F.col("name").alias("ask"), "id"), "exports")
    ways = imports.filter("alias IS NOT NULL AND symbol IS NOT NULL OR alias IS NULL AND symbol IS NULL")
    ways = ways.select(F.col("path").alias("at"), "alias", "symbol", "rid", F.col("file").alias("to"))
    front = kept(wanted.distinct().select("file", "symbol", F.col("file").alias("at"), F.col("symbol").alias("ask"), F.array().cast("array<bigint>").alias("way")), "export-front")
    seen, found = front.select("file", "symbol", "at", "ask"), None
    for hop in range(hops + 1):
        hits = front.join(here, ["at", "ask"]).groupBy("file", "symbol").agg(F.min_by("id", "way").alias("id"))
        hits = kept(hits, "export-hits")
        found = hits if found is None else found.unionByName(hits)
        if hop == hops:
            break
        left = front.join(hits, ["file", "symbol"], "left_anti")
        step = left.join(ways.withColumnRenamed("symbol", "given"), "at").filter((F.col("alias") == F.col("ask")) | F.col("alias").isNull())
        step = step.select("file", "symbol", F.col("to").alias("at"), F.coalesce("given", "ask").alias("ask"), F.concat("way", F.array("rid")).alias("way"))
        step = step.groupBy("file", "symbol", "at", "ask").agg(F.min("way").alias("way"))
        front = kept(step.join(seen, ["file", "symbol", "at", "ask"], "left_anti"), "export-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("file", "symbol", "at", "ask"))
    return found


def place_imports(imports: DataFrame, modules: DataFrame, nodes: DataFrame) -> DataFrame:
    """rid, path, alias, symbol, id, kind, target_path and via: what each import binds, and the barrel it came through.

    A named symbol is looked for in the module's file and in what that passes on; ``default`` is the preferred
    exported definition; else the file's module is meant.  A symbol that landed on a module may be a module
    below it.  Imports of modules that aren't in the tree have no row.
    """
    defs = nodes.filter("kind <> 'module'")
    files = kept(target_files(imports, modules), "import-files")
    placed = kept(imports.join(files, "rid", "left"), "import-targets")
    named = placed.filter("file IS NOT NULL AND symbol IS NOT NULL AND symbol <> 'default'")
    symbols = exported_symbols(named.select("file", "symbol"), placed.filter("file IS NOT NULL"), defs)
    default = _best(defs.filter("exported"), "path").select(F.col("path").alias("file"), F.lit("default").alias("symbol"), "id")
    module = nodes.filter("kind = 'module'").groupBy(F.col("path").alias("file")).agg(F.min("id").alias("module_id"))
    first = placed.join(symbols.unionByName(default), ["file", "symbol"], "left").join(module, "file", "left")
    below = placed.filter("symbol IS NOT NULL").withColumn("module", submodule(F.col("family"), F.col("module"), F.col("symbol")))
    nested = target_files(below.drop("file"), modules).join(module, "file").select("rid", F.col("module_id").alias("nested_id"))
    # the submodule counts if the symbol isn't defined where it was looked for
    target = F.coalesce("id", F.when(F.col("symbol").isNotNull(), F.col("nested_id")), "module_id")
    done = first.join(nested, "rid", "left").select("rid", "path", "alias", "symbol", "file", "module_id", target.alias("id")).filter("id IS NOT NULL")
    about = nodes.select("id", "kind", F.col("path").alias("target_path"))
    via = F.when((F.col("target_path") != F.col("file")) & (F.col("module_id") != F.col("id")), F.col("module_id"))
    return done.join(about, "id").select("rid", "path", "alias", "symbol", "id", "kind", "target_path", via.alias("via"), F.col("file").alias("via_path"))


def visible_files(placed: DataFrame) -> DataFrame:
    """(path, seen): the files that a file imports from, both ends of what is passed on."""
    ends = placed.select("path", F.explode(F.array_distinct(F.array_compact(F.array("target_path", F.when(F.col("via").isNotNull(), F.col("via_path")))))).alias("seen"))
    return ends.filter("path <> seen").distinct()


def _members(rows: DataFrame, nodes: DataFrame, bases: DataFrame, levels: int = 2) -> DataFrame:
    """(rid, id): member ``name`` of the type ``holder`` (an id), or of the nearest of its bases."""
    split = nodes.filter("kind <> 'module' AND locate('.', qualified) > 0").select(
        "path", F.regexp_extract("qualified", r"^(.*)\.[^.]*$", 1).alias("owner_name"), F.regexp_extract("qualified", r"([^.]*)$", 1).alias("name"), "id"
    )
    types = nodes.filter(F.col("kind").isin(*TYPES)).select("path", F.col("qualified").alias("owner_name"), F.col("id").alias("holder"))
    own = kept(split.join(types, ["path", "owner_name"]).groupBy("holder", "name").agg(F.min("id").alias("id")), "members")
    step, found = rows.select("rid", "holder", "name"), None
    for level in range(levels + 1):
        hit = step.join(own, ["holder", "name"]).select("rid", "id", F.lit(level).alias("level"))
        found = hit if found is None else found.unionByName(hit)
        step = step.join(bases, step["holder"] == bases["owner"]).select("rid", F.col("base").alias("holder"), "name")
    return found.groupBy("rid").agg(F.min(F.struct("level", "id")).alias("m")).select("rid", F.col("m.id").alias("id"))


def _as(rows: DataFrame, rung: str, confidence: str | Column) -> DataFrame:
    level = F.lit(confidence) if isinstance(confidence, str) else confidence
    return rows.select("rid", "id", F.lit(RUNGS.index(rung)).alias("rung"), level.alias("confidence"))


def _counted(candidates_: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Numbers of candidates of each key, and the candidates of keys that have ``most`` at most."""
    counts = candidates_.groupBy(*by).agg(F.count("*").alias("n"))
    few = counts.filter(F.col("n") <= most)
    return counts, candidates_.join(few, by)


def shaped(defs: DataFrame) -> DataFrame:
    """Each definition for each shape of reference that it fits: any, a bare call (no method), a call on a receiver (no function).

    A bare name in Swift fits top-level declarations in Swift only.
    """
    top = F.when((F.col("lang") == "swift") & (F.col("qualified") == F.col("name")), "swift")
    fits = F.array_compact(F.array(F.lit("any"), F.when(F.col("kind") != "method", "bare"), F.when(F.col("kind") != "function", "on"), top))
    return defs.withColumn("shape", F.explode(fits))


def asked_for(defs: DataFrame, asked: DataFrame) -> DataFrame:
    """Shaped definitions whose name and shape are among ``asked``: no other can meet a reference by its name."""
    return defs.join(asked.select("name", "shape").distinct(), ["name", "shape"], "left_semi")


def scopes(placed: DataFrame, defs: DataFrame, packages: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(path, key) of the scopes that a file sees, and of those that its definitions are in.

    A file is a scope of its own, and so is a package whose files share one (path, package, shared; ``wide`` if an
    import opens the whole package too).  Two files never meet: both meet their scopes.
    """
    own = defs.select("path").distinct()
    in_file = F.concat(F.lit("file:"), F.col("path"))
    sees = visible_files(placed).select("path", F.concat(F.lit("file:"), F.col("seen")).alias("key"))
    sees = sees.unionByName(own.union(placed.select("path")).distinct().select("path", in_file.alias("key")))
    lies = own.select("path", in_file.alias("key"))
    if packages is not None:
        shared = packages.filter("shared").select("path", F.concat(F.lit("package:"), F.col("package")).alias("key"))
        wide = packages.filter("shared AND wide").select(F.col("path").alias("seen"), F.concat(F.lit("package:"), F.col("package")).alias("key"))
        opened = visible_files(placed).join(wide, "seen").select("path", "key")
        sees, lies = sees.unionByName(shared).unionByName(opened).distinct(), lies.unionByName(shared)
    return sees, lies


def _ways(asked: DataFrame, sees: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, key) of the scopes whose lists go to a file that asks, and of those to which what it asks for goes."""
    asks, sizes = asked.groupBy("path").agg(F.count("*").alias("asks")), lists.groupBy("key").agg(F.count("*").alias("size"))
    ways = kept(sees.join(asks, "path").join(sizes, "key"), "scope-ways")
    return ways.filter("size <= asks").select("path", "key"), ways.filter("size > asks").select("path", "key")


def visible_candidates(asked: DataFrame, sees: DataFrame, lies: DataFrame, defs: DataFrame, most: int = MOST) -> DataFrame:
    """(path, name, shape, id, n) for the distinct (path, name, shape) that are asked and have up to ``most`` visible definitions.

    Definitions whose name and shape are asked anywhere are listed by scope and name, up to ``most`` of them.  For
    each scope that a file sees the fewer rows travel: the scope's lists if they are no more than what the file
    asks for, else what it asks for.
    """
    by = ["key", "name", "shape"]
    asked = kept(asked, "asked-names")
    known = asked_for(shaped(defs), asked).join(lies, "path").select(*by, "id")
    counts, few = _counted(known, by, most)
    none = F.lit(None).cast("array<string>")
    lists = few.groupBy(*by).agg(F.collect_list("id").alias("ids")).unionByName(counts.filter(F.col("n") > most).select(*by, none.alias("ids")))
    lists = kept(lists, "scope-lists")
    listed, asking = _ways(asked, sees, lists)
    from_lists = listed.join(lists, "key").join(asked, ["path", "name", "shape"], "left_semi")
    from_asked = asked.join(asking, "path").join(lists, by)
    columns = ["path", "name", "shape", "ids"]
    met = from_lists.select(*columns).unionByName(from_asked.select(*columns)).groupBy("path", "name", "shape")
    found = met.agg(F.max(F.col("ids").isNull()).alias("many"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("n", F.size("ids"))
    return found.filter(~F.col("many") & (F.col("n") <= most)).select("path", "name", "shape", F.explode("ids").alias("id"), "n")


def swift_rungs(
    refs: DataFrame, nodes: DataFrame, defs: DataFrame, bound: DataFrame, bases: DataFrame, sees: DataFrame, lies: DataFrame, packages: DataFrame | None
) -> list[tuple[str, DataFrame, str | Column]]:
    """The rungs of Swift references: a type is spread over files by its extensions, and a module is one scope.

    In its file a bare name means what is at the top, or a member of the types around it, whose dotted names are
    the candidates.  A member is then looked for by its qualified name in all scopes that the file sees: that of
    the type around for a bare name and for self, else of the receiver's; or on what a type declared in the
    file is based on.  A receiver may also be an imported module.
    """
    types = F.col("kind").isin(*TYPES)
    owner = F.nullif(F.regexp_extract("qualified", r"^(.*)\.[^.]*$", 1), F.lit(""))
    around = nodes.select(F.col("id").alias("src_id"), F.when(types, F.col("qualified")).when(F.col("kind").isin("method", "constant"), owner).alias("around"))
    rows = kept(refs.join(around, "src_id", "left"), "swift-refs")
    own = defs.filter("lang = 'swift'").withColumn("owner", F.coalesce(owner, F.lit("")))

    parts = F.split("around", "[.]")
    outer = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    none = F.array().cast("array<string>")
    owners = F.when(F.col("selfish"), F.when(F.col("around").isNotNull(), F.array("around")).otherwise(none)).otherwise(F.concat(F.array(F.lit("")), F.coalesce(outer, none)))
    local = rows.filter("bare OR selfish").select("rid", "path", "name", F.explode(owners).alias("owner"))
    found = local.join(own.select("path", "name", "owner", "id", "kind", "exported"), ["path", "name", "owner"])
    here = found.groupBy("rid").agg(F.min_by("id", _order()).alias("id"), F.count("*").alias("n"))

    of = F.when(F.col("bare") | F.col("selfish") | (F.col("qualifier") == "super"), F.col("around")).otherwise(F.col("qualifier"))
    asks = kept(rows.withColumn("of", of).filter("of IS NOT NULL"), "swift-asks")
    wanted = asks.filter("NOT (qualifier <=> 'super')").withColumn("whole", F.concat_ws(".", "of", "name"))
    spread = own.join(lies, "path").select("key", F.col("qualified").alias("whole"), "id", "kind", "exported", F.col("path").alias("at"))
    best = spread.groupBy("key", "whole").agg(F.min(F.struct(rank_in(KIND_PRIORITY, "kind"), ~F.col("exported"), "at", "id")).alias("best"))
    members = wanted.select("path", "whole").distinct().join(sees, "path").join(best, ["key", "whole"]).groupBy("path", "whole").agg(F.min("best").alias("best"))
    declared = wanted.join(members, ["path", "whole"]).select("rid", F.col("best.id").alias("id"))
    holders = own.filter(types).groupBy("path", F.col("qualified").alias("of")).agg(F.min_by("id", _order()).alias("holder"))
    held = asks.join(declared, "rid", "left_anti").join(holders, ["path", "of"]).select("rid", "holder", "name")
    # a type's own members were looked for already
    above = held.join(bases, held["holder"] == bases["owner"]).select("rid", F.col("base").alias("holder"), "name")
    inherited = _members(above, nodes, bases, 1)

    out = [("same_file", here.select("rid", "id", "n"), F.when(F.col("n") == 1, "exact").otherwise("resolved")), ("swift_member", declared, "resolved"), ("swift_member", inherited, "resolved")]
    if packages is not None:
        # a module's own name, and then the qualified name of something at its top
        heads = rows.filter("NOT bare AND NOT selfish").select("rid", "path", "name", "qualifier", F.split("qualifier", "[.]")[0].alias("head"))
        modules = heads.join(bound.filter("to.kind = 'module'").select("path", "head", F.col("to.target_path").alias("target")), ["path", "head"])
        rest = F.regexp_extract("qualifier", r"^[^.]*\.(.*)$", 1)
        modules = modules.select("rid", "target", F.when(rest == "", F.col("name")).otherwise(F.concat_ws(".", rest, "name")).alias("whole"))
        units = packages.select("path", "package")
        tops = own.join(units, "path").groupBy("package", F.col("qualified").alias("whole")).agg(F.min_by("id", _order()).alias("id"))
        out.append(("receiver", modules.join(units.withColumnRenamed("path", "target"), "target").join(tops, ["package", "whole"]).select("rid", "id"), "resolved"))
    return out


def resolve(
    refs: DataFrame,
    nodes: DataFrame,
    placed: DataFrame,
    bases: DataFrame,
    linked: DataFrame | None = None,
    most: int = MOST,
    packages: DataFrame | None = None,
) -> DataFrame:
    """(rid, id, rung, confidence): what each ref means, by the first rung that has a target.

    ``placed`` are placed imports; ``linked`` are nodes of other repositories, if there are any; ``packages`` (path,
    package, shared, wide) says which files are one package, and whether they are one scope.
    """
    if "lang" not in nodes.columns:
        nodes = nodes.withColumn("lang", F.lit(None).cast("string"))
    defs = kept(nodes.filter("kind <> 'module'").select("id", "path", "name", "qualified", "kind", "exported", "lang"), "definitions")
    selfish = F.coalesce(F.col("qualifier").isin(*SELVES), F.lit(False))
    bare = F.col("qualifier").isNull()
    shape = F.when((F.col("type") != "calls") | selfish, "any").when(bare, "bare").otherwise("on")
    refs = kept(refs.withColumn("selfish", selfish).withColumn("bare", bare).withColumn("shape", shape), "refs")
    sees, lies = scopes(placed, defs, packages)
    swift, every = None, refs.filter("type <> 'queries'")
    if not defs.filter("lang = 'swift'").isEmpty():
        from_swift = nodes.filter("lang = 'swift'").select(F.col("id").alias("src_id"), F.lit(True).alias("is_swift"))
        every = kept(every.join(from_swift, "src_id", "left").withColumn("is_swift", F.coalesce("is_swift", F.lit(False))), "refs-by-language")
        swift = every.filter("is_swift").drop("is_swift")
        every = every.drop("is_swift")
        named = every.join(swift.select("rid"), "rid", "left_anti")
    else:
        named = every
    out = []

    _, few = _counted(defs.filter("kind = 'table'").select("name", "id"), ["name"], most)
    level = F.when(F.col("n") == 1, "resolved").otherwise("heuristic")
    out.append(_as(refs.filter("type = 'queries'").join(few, "name"), "tables", level))

    # self receivers: the enclosing type's member, there or inherited
    types = defs.filter(F.col("kind").isin(*TYPES))
    source = nodes.select(F.col("id").alias("src_id"), F.regexp_extract("qualified", r"^(.*)\.[^.]*$", 1).alias("owner_name")).filter("owner_name <> ''")
    inside = every.filter("selfish").join(source, "src_id")
    direct = defs.groupBy("path", F.col("qualified").alias("whole")).agg(F.min("id").alias("id"))
    declared = inside.withColumn("whole", F.concat_ws(".", "owner_name", "name")).join(direct, ["path", "whole"])
    enclosing = types.groupBy("path", F.col("qualified").alias("owner_name")).agg(F.min("id").alias("holder"))
    held = inside.join(declared.select("rid"), "rid", "left_anti").join(enclosing, ["path", "owner_name"])

    # receivers that an import binds, the first part of a qualifier before the whole; else types of this file
    bound = placed.filter("alias IS NOT NULL").groupBy("path", F.col("alias").alias("head")).agg(F.min_by(F.struct("id", "kind", "target_path"), "rid").alias("to"))
    bound = kept(bound, "bindings")
    on = named.filter("NOT bare AND NOT selfish")
    heads = on.select("rid", "path", "name", F.posexplode(F.array_distinct(F.array(F.split("qualifier", "[.]")[0], "qualifier"))).alias("pos", "head"))
    held_by = heads.join(bound, ["path", "head"]).groupBy("rid", "name").agg(F.min_by("to", "pos").alias("to"))
    held_by = kept(held_by.select("rid", "name", "to.*"), "holders")
    by_file = _best(defs, "path", "name").select("path", "name", "id")
    modules = held_by.filter("kind = 'module'").select("rid", "name", F.col("target_path").alias("path"))
    if packages is None:
        in_module = modules.join(by_file, ["path", "name"])
    else:
        # a module is all files of its package
        unit = F.coalesce("package", F.col("path")).alias("unit")
        by_unit = _best(defs.join(packages.select("path", "package"), "path", "left").withColumn("unit", unit), "unit", "name").select("unit", "name", "id")
        in_module = modules.join(packages.select("path", "package"), "path", "left").select("rid", "name", unit).join(by_unit, ["unit", "name"])
    on_type = held_by.filter(F.col("kind").isin(*TYPES)).select("rid", F.col("id").alias("holder"), "name")
    local = types.groupBy("path", F.col("name").alias("head")).agg(F.min_by("id", _order()).alias("holder"))
    on_local = on.withColumn("head", F.split("qualifier", "[.]")[0]).join(local, ["path", "head"]).select("rid", "holder", "name")
    both = held.select("rid", "holder", "name", F.lit("self").alias("why")).unionByName(on_type.withColumn("why", F.lit("receiver"))).unionByName(
        on_local.withColumn("why", F.lit("local_type"))
    )
    # a ref has a holder for each reason at most, so reasons are told apart by the key
    keyed = kept(both.withColumn("ref", F.col("rid")).withColumn("rid", F.concat_ws("/", F.col("rid").cast("string"), "why")), "held-refs")
    members = _members(keyed, nodes, bases).join(keyed.select("rid", "ref", "why"), "rid").select(F.col("ref").alias("rid"), "id", "why")
    members = kept(members, "member-hits")
    out.append(_as(declared, "self", "resolved"))
    for why in ("self", "receiver", "local_type"):
        out.append(_as(members.filter(F.col("why") == why), why, "resolved"))
    out.append(_as(in_module, "receiver", "resolved"))

    here = named.filter("bare OR selfish").join(_best(defs, "path", "name"), ["path", "name"])
    out.append(_as(here, "same_file", F.when(F.col("n") == 1, "exact").otherwise("resolved")))

    # names that imports bind, then names of modules that are imported whole without a name
    free = named.filter("bare")
    alias = bound.select("path", F.col("head").alias("name"), F.col("to.id").alias("id"))
    out.append(_as(free.join(alias, ["path", "name"]), "imported", "resolved"))
    stars = placed.filter("alias IS NULL AND symbol IS NULL AND kind = 'module'").select("path", F.col("target_path").alias("from"), F.col("rid").alias("pos"))
    pulled = stars.join(by_file.withColumnRenamed("path", "from"), "from").groupBy("path", "name").agg(F.min_by("id", "pos").alias("id"))
    pulled = pulled.join(alias.select("path", "name"), ["path", "name"], "left_anti")
    out.append(_as(free.join(pulled, ["path", "name"]), "imported", "resolved"))

    if swift is not None:
        for rung, rows, confidence in swift_rungs(swift, nodes, defs, bound, bases, sees, lies, packages):
            out.append(_as(rows, rung, confidence))
        # what is left of a bare name is a declaration at the top; others stop here
        named = named.unionByName(swift.filter("bare").withColumn("shape", F.lit("swift")))

    # candidates that a file can see
    few = visible_candidates(named.select("path", "name", "shape").distinct(), sees, lies, defs, most)
    hits = kept(named.join(few, ["path", "name", "shape"]).select("rid", "id", "n", "bare", "selfish"), "visible-hits")
    out.append(_as(hits.filter("n = 1"), "visible", "resolved"))
    out.append(_as(hits.filter("n > 1 AND NOT bare AND NOT selfish"), "qualified", "heuristic"))

    # candidates anywhere, of names without a receiver
    loose = named.filter("bare OR selfish")
    counts, few = _counted(asked_for(shaped(defs), loose).select("name", "shape", "id"), ["name", "shape"], most)
    out.append(_as(loose.join(few, ["name", "shape"]), "global", "heuristic"))
    if linked is not None:
        one = linked.filter("exported AND kind <> 'module'").groupBy("name").agg(F.count("*").alias("m"), F.min("id").alias("id")).filter("m = 1")
        unknown = loose.join(counts.select("name", "shape"), ["name", "shape"], "left_anti")
        out.append(_as(unknown.join(one, "name"), "linked", "heuristic"))

    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    # a ref has a constant number of rows at most
    hits = F.collect_set(F.struct("rung", "id", "confidence")).alias("hits")
    first = rows.groupBy("rid").agg(hits, F.min("rung").alias("least")).select("rid", F.explode(F.filter("hits", lambda h: h["rung"] == F.col("least"))).alias("h"))
    return first.select("rid", "h.id", F.element_at(F.array(*[F.lit(r) for r in RUNGS]), F.col("h.rung") + 1).alias("rung"), "h.confidence")


def edges_of(resolved: DataFrame, refs: DataFrame) -> DataFrame:
    """src_id, dst_id, type, confidence and rid of resolved refs; one that means itself counts as resolved and makes no edge."""
    joined = resolved.join(refs.select("rid", "src_id", "type"), "rid").filter("src_id <> id")
    return joined.select("src_id", F.col("id").alias("dst_id"), "type", "confidence", "rid")
