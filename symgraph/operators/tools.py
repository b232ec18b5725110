"""The question tools: each returns a DataFrame, and ``render`` makes the budgeted text of one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CALL_TYPES, IMPACT_TYPES, KIND_ORDER, rank_in
from . import graph, lookup, rank

DEPTHS = (1, 6)
LIMITS = (1, 200)


def clamp(value: int | None, bounds: tuple[int, int], default: int) -> int:
    return default if value is None else max(bounds[0], min(bounds[1], int(value)))


def search_symbols(nodes: DataFrame, query: str, kind: str | None = None, lang: str | None = None, limit: int | None = None) -> DataFrame:
    """The best fuzzy hits, in order (a top-k report)."""
    return lookup.fuzzy(nodes, query, clamp(limit, LIMITS, 25), kind, lang)


def more_symbols(nodes: DataFrame, query: str, kind: str | None = None, lang: str | None = None, limit: int | None = None) -> bool:
    """Whether there are more hits than the limit."""
    most = clamp(limit, LIMITS, 25)
    return lookup.search(nodes, query, kind, lang).limit(most + 1).count() > most


def in_order(matches: DataFrame) -> DataFrame:
    """Matches as they are listed: exported first, by kind, path and line."""
    line = ["line_start"] if "line_start" in matches.columns else []
    return matches.orderBy(F.col("exported").desc(), rank_in(KIND_ORDER, "kind"), "path", *line, "id")


def where_defined(nodes: DataFrame, name: str, cap: int = 20) -> DataFrame:
    """The symbols of the ladder's first rung for a name, in order; those most like it if no rung has any."""
    names = nodes.sparkSession.createDataFrame([(name,)], "q string")
    found = lookup.ladder(names, nodes)
    if found.isEmpty():
        return lookup.fuzzy(nodes, name)
    return in_order(found.join(nodes, "id")).limit(cap)


def not_found(nodes: DataFrame, name: str) -> DataFrame:
    return lookup.suggestions(nodes, name)


def callers(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int | None = None, evidence: bool = True) -> DataFrame:
    return _named(nodes, graph.traverse(edges, roots, clamp(depth, DEPTHS, 1), "in", CALL_TYPES, evidence=evidence))


def find_callers(nodes: DataFrame, edges: DataFrame, names: DataFrame, depth: int | None = None, evidence: bool = True) -> DataFrame:
    """root (a name), id, distance, via (if asked for) and the symbol: what calls any symbol that the ladder finds for each name (q)."""
    roots = lookup.ladder(names, nodes).select(F.col("q").alias("root"), "id")
    return callers(nodes, edges, roots, depth, evidence)


def callees(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    return _named(nodes, graph.traverse(edges, roots, clamp(depth, DEPTHS, 1), "out", CALL_TYPES))


def foreign_callers(edges: DataFrame, roots: DataFrame, own: str, cap: int = 10) -> DataFrame:
    """repo, caller, path, line of edges of any type from other repositories (``repo`` of ``edges``) to the roots.

    The first ``cap`` of each repository, by path and line, with their rank and how many there are.
    """
    hits = edges.filter(F.col("repo") != own).join(roots.select(F.col("id").alias("dst_id")).distinct(), "dst_id")
    rows = hits.select("repo", F.col("src_id").alias("caller"), "path", "line", "dst_id")
    return rank.first_per_group(rows, ["repo"], ["path", "line", "caller", "dst_id"], cap)


def impact_of(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int | None = None, max_nodes: int | None = 4000) -> DataFrame:
    return _named(nodes, graph.traverse(edges, roots, clamp(depth, DEPTHS, 3), "in", IMPACT_TYPES, max_nodes))


def by_file(reached: DataFrame, cap: int | None = None) -> DataFrame:
    """path, best distance and number of symbols of each file, the nearest files first."""
    files = reached.groupBy("path").agg(F.min("distance").alias("best"), F.count("*").alias("items")).orderBy("best", "path")
    return files if cap is None else files.limit(cap)


def impact_numbers(reached: DataFrame) -> DataFrame:
    """One row: affected symbols and files, those next to the root, and those that only a guess leads to."""
    return reached.agg(
        F.count("*").alias("symbols"), F.count_distinct("path").alias("files"), F.count_if(F.col("distance") == 1).alias("direct"),
        F.count_if(F.col("via.confidence") == "heuristic").alias("heuristic"),
    )


def shortest_path(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> list[str] | None:
    """The hops from one symbol to another, each as ``x -> y`` or, against its direction, ``x <- y``; None if there is no way."""
    spark = nodes.sparkSession
    ends = []
    for name in (a, b):
        first = where_defined(nodes, name, 1).first()
        if first is None:
            return None
        ends.append(first["id"])
    found = graph.shortest_paths(edges, spark.createDataFrame([tuple(ends)], "a string, b string")).first()
    if found is None:
        return None
    lines, at = [], ends[0]
    for hop in found["hops"]:
        forward = hop["src_id"] == at
        to = hop["dst_id"] if forward else hop["src_id"]
        lines.append(f"{at} {'->' if forward else '<-'} {to} ({hop['type']})")
        at = to
    return lines


def changed_since(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int | None = None, max_nodes: int | None = 400, evidence: bool = True) -> DataFrame:
    """root (a changed path), id, distance, via (if asked for) and the symbol: what depends on each changed file from outside of it."""
    roots = nodes.filter("kind <> 'module'").join(changed.select("path").distinct(), "path").select(F.col("path").alias("root"), "id")
    reached = graph.traverse(edges, roots, clamp(depth, DEPTHS, 2), "in", IMPACT_TYPES, max_nodes, evidence)
    return _named(nodes, reached).filter("path <> root")


def status(nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> dict[str, DataFrame]:
    """Row counts, open references among them, and relationships by type and by confidence."""
    type_, level = F.col("type"), F.col("confidence")
    counts = [
        nodes.agg(F.lit("files").alias("what"), F.count_distinct("path").alias("n")),
        nodes.agg(F.lit("symbols").alias("what"), F.count("*").alias("n")),
        edges.agg(F.lit("relationships").alias("what"), F.count("*").alias("n")),
        refs.agg(F.lit("open").alias("what"), F.count_if(~F.col("resolved")).alias("n")),
    ]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return {"counts": rows, "edges": edges.groupingSets([[type_], [level]], type_, level).agg(F.count("*").alias("n")).select("type", "confidence", "n")}


def roots_of(nodes: DataFrame, target: str) -> DataFrame:
    """(root, id) of a file, of what is below a directory, or of a symbol by the ladder."""
    if "/" in target or re.search(r"\.[A-Za-z0-9]{1,5}$", target):
        below = nodes.filter((F.col("path") == target) | F.col("path").startswith(target.rstrip("/") + "/"))
        if not below.isEmpty():
            return below.select(F.lit(target).alias("root"), "id")
    names = nodes.sparkSession.createDataFrame([(target,)], "q string")
    return lookup.ladder(names, nodes).select(F.col("q").alias("root"), "id")


def get_symbol(nodes: DataFrame, edges: DataFrame, ids: DataFrame, cap: int = 12) -> DataFrame:
    """Neighbours of each symbol by direction and type, the best ``cap`` of each, and how many there are."""
    found = graph.neighbours(edges, ids)
    capped = rank.first_per_group(found, ["id", "direction", "type"], ["via.conf_rank", "via.path", "via.line", "other"], cap)
    other = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("path").alias("other_path"))
    return capped.join(other, "other", "left").orderBy("id", "direction", "type", "rank")


def overview(nodes: DataFrame, edges: DataFrame, scope: str = "") -> dict[str, DataFrame]:
    """Kinds, endpoints, hubs, entry points and directories of a scope, each in order; but for kinds top-k reports."""
    own = nodes if not scope else nodes.filter((F.col("path") == scope) | F.col("path").startswith(scope.rstrip("/") + "/"))
    degree = graph.in_degree(edges)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")
    unused = own.filter("kind = 'function' AND exported").join(degree, "id", "left_anti")
    line = ["line_start"] if "line_start" in nodes.columns else []
    return {
        "kinds": own.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kind"),
        "endpoints": own.filter("kind = 'endpoint'").orderBy("path", *line, "id").limit(15),
        "hubs": own.join(degree, "id").orderBy(F.col("degree").desc(), "path", "id").limit(12),
        "entry_points": unused.orderBy("path", "name", "id").limit(12),
        "dirs": own.groupBy(folder).agg(F.count_distinct("path").alias("files"), F.count("*").alias("symbols")).orderBy(F.col("symbols").desc(), "dir").limit(20),
    }


def _named(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Reached ids with their symbols; ids without one are dropped only here, so paths lead through them."""
    return reached.join(nodes, "id")


def render(answer: DataFrame, budget: int | None = None) -> str:
    """The text of an answer (distance, path, line_start, kind, qualified), grouped by file, within a budget.

    Lines are cut by Spark; only those that fit, at most the budget's tokens, come to the driver.
    """
    asked = rank.clamp_budget(budget)
    line = F.concat("kind", F.lit(" "), "qualified", F.lit("  "), "path", F.lit(":"), F.col("line_start").cast("string"))
    total = answer.count()
    # the shortest line costs three tokens, so more rows can't fit: the window sees a bounded number of rows
    head = answer.orderBy("distance", "path", "line_start", "id").limit(asked // 3 + 1)
    kept = rank.within_budget(head.withColumn("all", F.lit(0)).withColumn("line", line), asked, ["all"], ["distance", "path", "line_start", "id"])
    lines = [r["line"] for r in kept.orderBy("spent").collect()]
    if len(lines) < total:
        lines.append(f"omitted: {total - len(lines)}")
    return "\n".join(lines)
