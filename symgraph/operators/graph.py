"""Traversals: breadth-first levels as joins, for many roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CONFIDENCES, rank_in
from ..tables import kept
from .rank import first_per_group

#: Rows of a frontier that are broadcast at most; a larger one is shuffled with the edges.
FEW = 100_000
#: Ids, or rows of a few of them, that are broadcast at most.
IDS = 1_000_000
#: Rows of a step for each pair of ends that are written before it is known which of them meet.
STEPS = 64
#: Columns by which one of several edges to a node is preferred.
EDGE_ORDER = ("conf_rank", "path", "line", "dst_id", "src_id", "type")


def with_rank(edges: DataFrame) -> DataFrame:
    return edges.withColumn("conf_rank", rank_in(CONFIDENCES, "confidence"))


def only(rows: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ``on`` are in ``ids``, a kept table: rows don't move for it unless ids are very many."""
    return rows.join(F.broadcast(ids) if ids.count() <= IDS else ids, on, "left_semi")


def traverse(
    edges: DataFrame,
    roots: DataFrame,
    depth: int,
    direction: str = "in",
    types: tuple[str, ...] | None = None,
    max_nodes: int | None = None,
    evidence: bool = True,
) -> DataFrame:
    """(root, id, distance, via): what is reached from each (root, id) of ``roots`` within ``depth`` steps.

    A root isn't reached by itself.  Of several edges that reach a node at once, the first by EDGE_ORDER
    is kept as ``via``.  ``max_nodes`` bounds each root's result; the last level is cut in that order.
    Without ``evidence`` there is no ``via``, and without ``max_nodes`` too, only the ends of edges are carried.
    """
    here, there = ("dst_id", "src_id") if direction == "in" else ("src_id", "dst_id")
    usable = edges if types is None else edges.filter(F.col("type").isin(*types))
    plain = not evidence and max_nodes is None
    usable = usable.select("src_id", "dst_id") if plain else with_rank(usable)
    shown = ["root", "id", "distance", "via"] if evidence else ["root", "id", "distance"]
    frontier = kept(roots.select("root", "id").distinct(), "frontier")
    seen, size, reached = frontier, frontier.count(), None
    for distance in range(1, depth + 1):
        if size > FEW and distance > 1:
            # ends that no edge leads on from would only make all edges move
            frontier = kept(frontier.join(usable.select(F.col(here).alias("id")).distinct(), "id", "left_semi"), "frontier")
            size = frontier.count()
        if not size:
            break
        step = usable.join(F.broadcast(frontier) if size <= FEW else frontier, F.col(here) == F.col("id"))
        if plain:
            first = step.select("root", F.col(there).alias("id")).distinct()
        else:
            first = step.groupBy("root", F.col(there).alias("id")).agg(F.min(F.struct(*EDGE_ORDER, "confidence")).alias("via"))
        new = first.join(seen, ["root", "id"], "left_anti").withColumn("distance", F.lit(distance))
        if max_nodes is not None:
            new = _cut(new, seen, roots, max_nodes)
        new = kept(new.select(*shown), "level")
        size = new.count()
        if not size:
            break
        reached = new if reached is None else reached.unionByName(new)
        frontier = new.select("root", "id")
        seen = seen.unionByName(frontier)
    if reached is None:
        none = roots.select("root", "id").limit(0).select("root", "id", F.lit(0).alias("distance"))
        reached = none if not evidence else none.join(usable.select(F.struct(*EDGE_ORDER, "confidence").alias("via")).limit(0))
    return reached


def _cut(new: DataFrame, seen: DataFrame, roots: DataFrame, max_nodes: int) -> DataFrame:
    """The first rows of a level in edge order, as many as each root's bound leaves."""
    had = seen.join(roots.select("root", "id"), ["root", "id"], "left_anti").groupBy("root").agg(F.count("*").alias("had"))
    ranked = first_per_group(new, ["root"], ["via", "id"], max_nodes).join(had, "root", "left")
    return ranked.filter(F.col("rank") + F.coalesce("had", F.lit(0)) <= max_nodes)


_HOP = "array<struct<src_id:string,dst_id:string,type:string>>"


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 8) -> DataFrame:
    """(a, b, length, hops) for each pair that is connected, direction aside, within ``depth`` steps.

    Hops are the edges from a to b in order.  Both ends are searched, the one whose step makes fewer rows first,
    until a step meets what the other end has reached; a pair that is found is searched no further.  A step of
    many rows is first taken towards the other end only, and written as a level for pairs that it doesn't join.
    Levels keep an edge back only, and hops are put together at the end, by a join for each step.
    """
    ranked = with_rank(edges).select(*EDGE_ORDER)
    steps = ranked.select(F.col("src_id").alias("at"), F.col("dst_id").alias("to"), *EDGE_ORDER).unionByName(
        ranked.select(F.col("dst_id").alias("at"), F.col("src_id").alias("to"), *EDGE_ORDER)
    )
    ends = kept(pairs.select("a", "b").distinct(), "path-ends")
    found = ends.filter("a = b").select("a", "b", F.lit(0).alias("length"), F.array().cast(_HOP).alias("hops"))
    open_ = ends.filter("a <> b")
    sides = [[open_.select("a", "b", F.col(end).alias("id"))] for end in ("a", "b")]
    fronts, left = [s[0] for s in sides], open_.count()
    hop = F.struct(F.col("m.src_id").alias("src_id"), F.col("m.dst_id").alias("dst_id"), F.col("m.type").alias("type")).alias("hop")

    def reached(moved: DataFrame) -> DataFrame:
        first = moved.groupBy("a", "b", F.col("to").alias("id")).agg(F.min(F.struct(*EDGE_ORDER, "at")).alias("m"))
        return first.select("a", "b", "id", F.col("m.at").alias("back"), hop)

    def level(k: int) -> DataFrame:
        own = sides[k][0].select("a", "b", "id")
        for one in sides[k][1:]:
            own = own.unionByName(one.select("a", "b", "id"))
        return kept(reached(_moved(steps, fronts[k], ids[k])).join(own, ["a", "b", "id"], "left_anti"), "path-level")

    for length in range(1, depth + 1):
        if not left:
            break
        ids, costs = _costs(steps, fronts)
        if not min(costs):
            break
        k = 0 if costs[0] <= costs[1] else 1
        # what is met for the first time is met on the other end's last level
        last = fronts[1 - k].select("a", "b", "id")
        whole = costs[k] <= max(FEW, STEPS * left)
        if whole:
            new = level(k)
        else:
            towards = only(steps, ids[1 - k].select(F.col("id").alias("to")), ["to"])
            new = reached(_moved(towards, fronts[k], ids[k]).join(last.withColumnRenamed("id", "to"), ["a", "b", "to"]))
        met = new.join(last, ["a", "b", "id"]).groupBy("a", "b").agg(F.min_by(F.struct("id", "back", "hop"), "id").alias("m"))
        met = kept(met.select("a", "b", "m.*"), "path-meets")
        hits = met.count()
        levels = [[*side, met] if k == n else list(side) for n, side in enumerate(sides)]
        if whole:
            sides[k].append(new)
            fronts[k] = new.select("a", "b", "id")
        if hits:
            found, left = found.unionByName(_joined(met, levels, length)), left - hits
            fronts = [f.join(F.broadcast(met.select("a", "b")) if hits <= FEW else met.select("a", "b"), ["a", "b"], "left_anti") for f in fronts]
        if left and length < depth and not whole:
            sides[k].append(level(k))
            fronts[k] = sides[k][-1].select("a", "b", "id")
    return found


def _costs(steps: DataFrame, fronts: list[DataFrame]) -> tuple[list[DataFrame], list[int]]:
    """The different ids of each frontier, as tables, and how many rows a step from it makes."""
    ids = [kept(f.groupBy("id").agg(F.count("*").alias("n")), "path-ids") for f in fronts]
    both = ids[0].withColumn("side", F.lit(0)).unionByName(ids[1].withColumn("side", F.lit(1)))
    asked = kept(both.select(F.col("id").alias("at")).distinct(), "path-asked")
    degrees = only(steps.select("at"), asked, ["at"]).groupBy(F.col("at").alias("id")).agg(F.count("*").alias("degree"))
    sums = {r["side"]: r["cost"] for r in both.join(degrees, "id").groupBy("side").agg(F.sum(F.col("n") * F.col("degree")).alias("cost")).collect()}
    return ids, [sums.get(0, 0), sums.get(1, 0)]


def _moved(steps: DataFrame, front: DataFrame, ids: DataFrame) -> DataFrame:
    """The steps from a frontier; of a large one only those from its different ``ids`` are moved."""
    if front.count() <= FEW:
        return steps.join(F.broadcast(front), F.col("at") == F.col("id")).drop("id")
    return only(steps, ids.select(F.col("id").alias("at")), ["at"]).join(front, F.col("at") == F.col("id")).drop("id")


def _joined(met: DataFrame, sides: list[list[DataFrame]], length: int) -> DataFrame:
    """(a, b, length, hops) through the nodes where the two ends met."""
    rows = met.select("a", "b", "id", F.array().cast(_HOP).alias("hops")).withColumn("middle", F.col("id"))
    for k, levels in enumerate(sides):
        rows = rows.withColumn("id", F.col("middle"))
        for level in reversed(levels[1:]):
            own = level.select("a", "b", "id", "back", "hop")
            hops = F.concat(F.array("hop"), "hops") if k == 0 else F.concat("hops", F.array("hop"))
            rows = rows.join(own, ["a", "b", "id"]).select("a", "b", F.col("back").alias("id"), hops.alias("hops"), "middle")
    return rows.select("a", "b", F.lit(length).alias("length"), "hops")


def in_degree(edges: DataFrame) -> DataFrame:
    """(id, degree): inbound edges but for ``defines``, counted as rows."""
    return edges.filter("type <> 'defines'").groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, direction, other, type, via): each neighbour once for each type, by its first edge."""
    ranked = with_rank(edges)
    asked = kept(ids.select("id").distinct(), "asked")
    asked = F.broadcast(asked) if asked.count() <= IDS else asked
    sides = []
    for direction, here, there in (("out", "src_id", "dst_id"), ("in", "dst_id", "src_id")):
        sides.append(
            ranked.join(asked, F.col(here) == F.col("id"))
            .repartition("id", F.col(there))  # few edges are parallel, so rows are dealt before they are sorted and grouped
            .groupBy("id", F.lit(direction).alias("direction"), F.col(there).alias("other"), "type")
            .agg(F.min(F.struct("conf_rank", "path", "line", "confidence")).alias("via"))
        )
    return sides[0].unionByName(sides[1])


def most_neighbours(edges: DataFrame, ids: DataFrame) -> int:
    """The most edges that one of ``ids`` has in one direction: no group of its neighbours is larger."""
    asked, most = kept(ids.select("id").distinct(), "asked"), 0
    for end in ("src_id", "dst_id"):
        counts = only(edges.select(F.col(end).alias("id")), asked, ["id"]).groupBy("id").agg(F.count("*").alias("n"))
        most = max(most, counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    return most
