"""Changes to an index: what changed files bring and take, and which references that can touch.

A change reads changed files only.  References are resolved again if they are in a changed file, if their name is
one that a changed file had or has, if an import of their file is placed otherwise than before, or if a type's bases
changed and their name is a member that those bases had or have.  Others mean what they meant, as every rung
of the ladder is decided by a name, by the placed imports of a file or by bases.  The tables that result are those of
a build from nothing, but for the numbers of references.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import kept
from . import index as indexing
from . import ladder, store
from .index import Index


def save(made: Index, folder: str) -> None:
    for f in fields(Index):
        getattr(made, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")


def load(spark: SparkSession, folder: str) -> Index:
    return Index(*[spark.read.parquet(f"{folder}/{f.name}") for f in fields(Index)])


def _last(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max("rid"), F.lit(0))).first()[0]


def _moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose placed imports aren't what they were."""
    sign = F.bit_xor(F.xxhash64("rid", "alias", "symbol", "id", "kind", "target_path", "via", "via_path"))
    a, b = (x.groupBy("path").agg(sign.alias("sign"), F.count("*").alias("n")) for x in (before, after))
    b = b.withColumnsRenamed({"sign": "sign_after", "n": "n_after"})
    same = F.col("sign").eqNullSafe(F.col("sign_after")) & F.col("n").eqNullSafe(F.col("n_after"))
    return a.join(b, "path", "full").filter(~same).select("path")


def _member_names(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """Names of the members of types (id)."""
    owner = nodes.join(types, "id", "left_semi").select("path", F.col("qualified").alias("owner"))
    own = nodes.filter("kind <> 'module'").select("path", "name", F.regexp_extract("qualified", r"^(.*)\.[^.]*$", 1).alias("owner"))
    return own.join(owner, ["path", "owner"], "left_semi").select("name")


def apply(made: Index, changed: DataFrame, gone: DataFrame, linked: DataFrame | None = None) -> Index:
    """The index after ``changed`` files (path, lang, text), new ones among them, and without those that are ``gone`` (path)."""
    changed = kept(changed.select("path", "lang", "text"), "upkeep-files")
    paths = kept(store.changed_paths(changed, gone), "upkeep-paths")
    new_nodes, new_handlers, bound, found = indexing.extract(changed)
    nodes = kept(store.delete_paths(made.nodes, paths).unionByName(new_nodes), "upkeep-nodes")
    handlers = kept(store.delete_paths(made.handlers, paths).unionByName(new_handlers), "upkeep-handlers")
    modules = kept(store.delete_paths(made.modules, paths).unionByName(indexing.modules_of(changed)), "upkeep-modules")
    packages = kept(store.delete_paths(made.packages, paths).unionByName(indexing.packages_of(changed)), "upkeep-packages")
    imports = kept(store.delete_paths(made.imports, paths).unionByName(indexing.numbered_imports(bound, _last(made.imports))), "upkeep-imports")
    refs = kept(store.delete_paths(made.refs, paths).unionByName(indexing.numbered_refs(found, _last(made.refs))), "upkeep-refs")
    placed = kept(ladder.place_imports(imports, modules, nodes), "upkeep-placed")

    files = store.changed_paths(paths, _moved(made.placed, placed))
    names = store.dirty_names(made.nodes.join(paths, "path", "left_semi"), new_nodes)
    first = _dirty(refs.filter("type = 'inherits'"), files, names)
    none = nodes.sparkSession.createDataFrame([], "owner string, base string")
    old = made.resolved.join(refs.select("rid"), "rid", "left_semi")
    supers = kept(_replaced(old.join(refs.filter("type = 'inherits'"), "rid", "left_semi"), first, ladder.resolve(first, nodes, placed, none, linked, packages=packages)), "upkeep-supertypes")
    bases = kept(indexing.bases_of(supers, refs), "upkeep-bases")

    # what a changed base, or a base of it, has or had
    turned = kept(made.bases.exceptAll(bases).union(bases.exceptAll(made.bases)).select(F.col("base").alias("id")).distinct(), "upkeep-turned")
    over = made.bases.union(bases).join(turned.withColumnRenamed("id", "owner"), "owner", "left_semi").select(F.col("base").alias("id"))
    types = turned.union(over).distinct()
    names = names.union(_member_names(nodes, types)).union(_member_names(made.nodes, types)).distinct()
    second = _dirty(refs.filter("type <> 'inherits'"), files, kept(names, "upkeep-names"))
    again = ladder.resolve(second, nodes, placed, bases, linked, packages=packages)
    others = _replaced(old.join(refs.filter("type <> 'inherits'"), "rid", "left_semi"), second, again)
    resolved = kept(supers.unionByName(others), "upkeep-resolved")
    return Index(nodes, modules, packages, handlers, imports, placed, refs, bases, resolved, indexing.relate(nodes, handlers, imports, placed, refs, resolved))


def _dirty(refs: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    by_file = refs.join(files, "path", "left_semi")
    by_name = refs.join(names, "name", "left_semi")
    return kept(by_file.unionByName(by_name).dropDuplicates(["rid"]), "upkeep-dirty")


def _replaced(old: DataFrame, dirty: DataFrame, new: DataFrame) -> DataFrame:
    return store.delete_by_rid(old, dirty).unionByName(new)
