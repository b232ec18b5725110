"""Table maintenance as joins: upserts, deletions, ordinals, diffs of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import few_ordinals, ordinals


def upsert(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; ``order`` is the order of writing."""
    names = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*names), F.struct(*order))
    return rows.groupBy(*key).agg(last.alias("row")).select(*key, *[F.col("row")[c].alias(c) for c in names])


def upsert_modules(rows: DataFrame) -> DataFrame:
    """One row for each (path, module); canonical wins over alias."""
    return rows.groupBy("path", "module").agg(F.min("family").alias("family"), F.min("is_alias").alias("is_alias"))


def delete_paths(rows: DataFrame, paths: DataFrame, local_only: bool = False) -> DataFrame:
    """Rows but for those of the given paths; with ``local_only``, external ones stay."""
    if local_only:
        gone = rows.filter("NOT external").join(paths, "path", "left_anti")
        return gone.unionByName(rows.filter("external"))
    return rows.join(paths, "path", "left_anti")


def without_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes but for external ones that no edge points at."""
    orphans = nodes.filter("external").join(edges, nodes["id"] == edges["dst_id"], "left_anti").select("id")
    return nodes.join(orphans, "id", "left_anti")


def numbered_ids(rows: DataFrame, key: list[str], order: list[str], name: str, small: bool = False) -> DataFrame:
    """``name`` with #2, #3, ... for the later rows of equal keys; ``small`` says that no key has many rows, as in a file."""
    return (few_ordinals if small else ordinals)(rows, key, order).withColumn(
        "id", F.when(F.col("ordinal") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), F.col("ordinal").cast("string")))
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between snapshots with path, hash, size and mtime_ms.

    added, deleted, same (size and time agree), touched (only they differ) or modified (the hash does).
    """
    a = old.select("path", F.lit(True).alias("was"), F.col("hash").alias("h0"), F.col("size").alias("s0"), F.col("mtime_ms").alias("m0"))
    b = new.select("path", F.lit(True).alias("is"), F.col("hash").alias("h1"), F.col("size").alias("s1"), F.col("mtime_ms").alias("m1"))
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "deleted")
        .when(F.col("s0").eqNullSafe(F.col("s1")) & F.col("m0").eqNullSafe(F.col("m1")), "same")
        .when(F.col("h0").eqNullSafe(F.col("h1")), "touched")
        .otherwise("modified")
    )
    return a.join(b, "path", "full").select("path", change.alias("change"))


def dirty_refs(refs: DataFrame, changed: DataFrame, names: DataFrame) -> DataFrame:
    """Refs to resolve again: of changed files, of dirty names, all imports and all that are unresolved."""
    by_file = refs.join(changed, "path", "left_semi")
    by_name = refs.join(names, "name", "left_semi")
    rest = refs.filter("type = 'imports' OR NOT resolved")
    return by_file.unionByName(by_name).unionByName(rest).dropDuplicates(["rid"])


def dirty_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names that a change took away or brought, each once."""
    return before.select("name").union(after.select("name")).distinct()


def changed_paths(*lists: DataFrame) -> DataFrame:
    """The paths of several lists of changes, each once."""
    out = lists[0].select("path")
    for more in lists[1:]:
        out = out.union(more.select("path"))
    return out.distinct()


def refs_naming(refs: DataFrame, names: DataFrame) -> DataFrame:
    """Refs whose name or imported symbol is among ``names``, each once."""
    either = refs.withColumn("__name", F.explode(F.array_distinct(F.array_compact(F.array("name", "symbol")))))
    hit = either.join(names.select(F.col("name").alias("__name")), "__name", "left_semi")
    return hit.drop("__name").dropDuplicates(["rid"])


def delete_by_rid(rows: DataFrame, rids: DataFrame) -> DataFrame:
    """Rows, such as edges, but for those of the given refs."""
    return rows.join(rids.select("rid").distinct(), "rid", "left_anti")


def mark_resolved(refs: DataFrame, rids: DataFrame) -> DataFrame:
    """Refs with the given ones marked as resolved."""
    done = rids.select("rid").distinct().withColumn("__done", F.lit(True))
    marked = refs.join(done, "rid", "left").withColumn("resolved", F.col("resolved") | F.coalesce("__done", F.lit(False)))
    return marked.drop("__done").select(*refs.columns)


def with_rids(rows: DataFrame, by: list[str], order: list[str], after: int = 0) -> DataFrame:
    """Rows with ``rid``, numbered gaplessly from ``after`` + 1; rows of a group (``by``) follow each other in order."""
    return ordinals(rows, [], [*by, *order], "__k").withColumn("rid", F.lit(after) + F.col("__k")).drop("__k")


def touched(changes: DataFrame, root: str) -> DataFrame:
    """Paths of changed files relative to ``root``; those outside of it are dropped."""
    base = root.rstrip("/") + "/"
    return changes.filter(F.col("path").startswith(base)).select(F.substring("path", len(base) + 1, 1 << 20).alias("path")).distinct()
