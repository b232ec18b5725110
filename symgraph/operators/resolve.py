"""Reference resolution: candidates by name, gated by how many there are and how near they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import KIND_PRIORITY, rank_in

#: A name with more candidates than this says too little.
MOST = 4


def prefer(candidates: DataFrame, by: list[str]) -> DataFrame:
    """One candidate of each group: the preferred kind, exported before hidden, then path and id."""
    order = F.struct(rank_in(KIND_PRIORITY, "kind"), ~F.col("exported"), "path", "id")
    return candidates.groupBy(*by).agg(F.min_by("id", order).alias("id"))


def gate(n: Column, most: int = MOST) -> Column:
    """What a number of candidates allows: one is resolved, up to ``most`` are heuristic, others nothing."""
    return F.when(n == 1, F.lit("resolved")).when(n.between(2, most), F.lit("heuristic"))


def resolve_names(refs: DataFrame, definitions: DataFrame, most: int = MOST) -> DataFrame:
    """(rid, id, confidence) for refs (rid, path, name, qualifier), by the first rung that has candidates.

    Rungs: a bare name with one definition in its file is exact, with several the preferred one is resolved;
    one candidate that is visible is resolved; two to ``most`` visible ones of a qualified name are all
    heuristic; so are one to ``most`` candidates anywhere of a bare name.  Candidates of a name are counted
    before they are joined, so a name that is everywhere never meets all of its refs.

    ``definitions`` has id, name, path, scope, kind and exported; a definition is visible from refs with
    its scope.
    """
    here = definitions.groupBy("path", "name").agg(
        F.count("*").alias("n"), F.min_by("id", F.struct(rank_in(KIND_PRIORITY, "kind"), ~F.col("exported"), "path", "id")).alias("id")
    )
    bare = F.col("qualifier").isNull()
    in_file = refs.filter(bare).join(here, ["path", "name"]).select(
        "rid", "id", F.when(F.col("n") == 1, F.lit("exact")).otherwise(F.lit("resolved")).alias("confidence")
    )
    left = refs.join(in_file.select("rid"), "rid", "left_anti")

    near = definitions.groupBy("scope", "name").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    seen = left.join(near, ["scope", "name"])
    single = seen.filter("n = 1").select("rid", F.col("only").alias("id"), F.lit("resolved").alias("confidence"))
    some = seen.filter((F.col("n") > 1) & (F.col("n") <= most) & F.col("qualifier").isNotNull()).select("rid", "scope", "name")
    several = some.join(definitions, ["scope", "name"]).select("rid", "id", F.lit("heuristic").alias("confidence"))

    far = definitions.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("name")
    unseen = left.filter(bare).join(single.select("rid"), "rid", "left_anti").join(far, "name", "left_semi").select("rid", "name")
    anywhere = unseen.join(definitions, "name").select("rid", "id", F.lit("heuristic").alias("confidence"))
    return in_file.unionByName(single).unionByName(several).unionByName(anywhere)


def first_hit(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(rid, path): the file of the first candidate module that another file has.

    ``imports`` has rid, path (the importer's), family and candidates in order; ``modules`` has path,
    family, module and is_alias.  Canonical names come before aliases.  An importer is one of the files that have
    a name at most, so of these only the first two are met: a name that all files have meets no more.
    """
    tried = imports.select("rid", F.col("path").alias("importer"), "family", F.posexplode("candidates").alias("pos", "module"))
    each = modules.filter("path IS NOT NULL").groupBy("family", "module", "path").agg(F.min("is_alias").alias("is_alias"))
    turn = F.row_number().over(Window.partitionBy("family", "module").orderBy("is_alias", "path"))
    found = tried.join(each.withColumn("turn", turn).filter("turn <= 2"), ["family", "module"]).filter("path <> importer")
    return found.groupBy("rid").agg(F.min(F.struct("pos", "is_alias", "path")).alias("m")).select("rid", F.col("m.path").alias("path"))


def inherited(refs: DataFrame, bases: DataFrame, members: DataFrame, levels: int = 2) -> DataFrame:
    """(rid, id): a member found on the nearest base type within ``levels``.

    ``refs`` has rid, owner and name; ``bases`` has owner and base; ``members`` has owner, name and id.
    """
    step, out = refs.select("rid", "owner", "name"), None
    for level in range(1, levels + 1):
        step = step.join(bases, "owner").select("rid", F.col("base").alias("owner"), "name")
        hit = step.join(members, ["owner", "name"]).select("rid", "id", F.lit(level).alias("level"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("rid").agg(F.min(F.struct("level", "id")).alias("m")).select("rid", F.col("m.id").alias("id"))


def unique_across(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """(rid, id): exported non-module definitions whose name is unique over all linked repositories."""
    one = (
        definitions.filter("exported AND kind <> 'module'")
        .groupBy("name")
        .agg(F.count("*").alias("n"), F.min("id").alias("id"))
        .filter("n = 1")
    )
    return refs.join(one.select("name", "id"), "name").select("rid", "id")


def longest_prefix(refs: DataFrame, packages: DataFrame) -> DataFrame:
    """(rid, package): the longest package that is the module of a ref or a path prefix of it.

    A module's own prefixes are looked up, so packages and refs meet by equality.
    """
    parts = F.split("module", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    tried = refs.select("rid", F.explode(prefixes).alias("package"))
    found = tried.join(packages.select("package").distinct(), "package")
    return found.groupBy("rid").agg(F.max_by("package", F.length("package")).alias("package"))


def alias_targets(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rid, candidates): what the path aliases of its project make of each module, in the order of patterns and targets.

    ``refs`` has rid, project and module; ``aliases`` has project, place, pattern and targets.  A pattern without a
    star is the whole module; else a module begins and ends as it does, and the star of a target is what is
    between.  Patterns are keyed by what is before their star, and a module's own beginnings, of the lengths that
    its project's patterns have, are looked up, so that modules and patterns meet by equality.
    """
    star = F.instr("pattern", "*")
    cut = aliases.withColumns(
        {
            "before": F.when(star > 0, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern")),
            "after": F.when(star > 0, F.expr("substring(pattern, instr(pattern, '*') + 1)")),
        }
    )
    lengths = cut.groupBy("project").agg(F.collect_set(F.length("before")).alias("lengths"))
    fitting = F.filter("lengths", lambda n: n <= F.length("module"))
    tried = refs.join(lengths, "project").select("rid", "project", "module", F.explode(F.transform(fitting, lambda n: F.substring(F.col("module"), F.lit(1), n))).alias("before"))
    met = tried.join(cut.select("project", "place", "before", "after", "targets"), ["project", "before"])
    room = F.length("module") - F.length("before") - F.length("after")
    whole = F.col("after").isNull() & (F.col("module") == F.col("before"))
    part = F.col("after").isNotNull() & (room >= 0) & F.endswith("module", "after")
    middle = F.substring(F.col("module"), F.length("before") + 1, room)
    filled = F.transform("targets", lambda t: F.when(F.col("after").isNotNull(), F.replace(t, F.lit("*"), middle)).otherwise(t))
    hits = met.filter(F.coalesce(whole | part, F.lit(False))).select("rid", "place", filled.alias("made"))
    listed = F.sort_array(F.collect_list(F.struct("place", "made")))
    return hits.groupBy("rid").agg(F.array_distinct(F.flatten(F.transform(listed, lambda x: x["made"]))).alias("candidates"))
