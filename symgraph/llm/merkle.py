"""A Merkle manifest of a dataset: leaves, roots, proofs and the check of tampered rows.

Rows are leaves.  Of each source, leaves ascend by doc_id, every 16 consecutive nodes become one, until one is
left; the sources' roots, in order, are the leaves of one more such tree.

Method: cogrouped subtree exchange.  Leaves are numbered inside their source by a range sort (no task sees a
whole source), and 4,096 of them, three levels of runs, are a superblock.  Superblocks are reduced to their
tops, tops are the nodes of the next storey, and so on until each source has one node; the subroots go through
the same storeys.  Going down again, what a superblock needs from outside, the siblings on the way from its
top to the root, is cogrouped with its nodes: the function reduces them again, joins inner and outer siblings
to proofs, and folds each leaf up to the root, in one pass.  Sources of up to 4,096 leaves share superblocks.

Defined results: of rows with equal doc_id the order is that of their leaf hashes; null ids come first; an
empty table gives an empty result; a null in any column is hashed as "-"; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .native import join_bounded
from .scratch import materialize

ARITY = 16
#: Levels of a superblock; it has 4,096 nodes.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf(**columns: Column) -> Column:
    """The hash of a row: each field as its number of bytes, a colon and its value, or "-"."""
    parts = []
    for name in FIELDS:
        value = columns.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def tampered_text() -> Column:
    """The text with A-Z lower-cased, of documents whose id's crc32 five divides; of others as it is."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return F.when(hit, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with ``pos``, from 0 inside their group, and ``total``, the rows of the group.

    A range sort deals rows to parts; parts count their groups, and a part's rows follow those of the parts
    before it, so that a group of any size is spread.  ``order`` must end in a key without ties.
    """
    dealt = materialize(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*by, *order]]).withColumn("__part", F.spark_partition_id()), "merkle-ranges")
    counts = dealt.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each part
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("total", F.sum("__n").over(group)).drop("__n")
    inside = Window.partitionBy("__part", *by).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (
        dealt.withColumn("__k", F.row_number().over(inside))
        .join(counts, ["__part", *by])
        .withColumn("pos", (F.col("__before") + F.col("__k") - 1).cast("bigint"))
        .drop("__part", "__k", "__before")
    )


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def reduced(nodes: list[str], total: int, depth: int) -> list[list[str]]:
    """The levels over ``nodes``: until one is left or, of a part of a larger tree, all ``depth`` of a superblock."""
    levels, whole = [nodes], total <= ARITY**depth
    while len(levels[-1]) > 1 if whole else len(levels) <= depth:
        last = levels[-1]
        levels.append([_hash(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return levels


def siblings(levels: list[list[str]], at: int) -> Iterator[tuple[int, list[str]]]:
    """For each level below the last: the node's place in its run, and the run's others."""
    for level in levels[:-1]:
        start = at - at % ARITY
        run = level[start : start + ARITY]
        yield at - start, run[: at - start] + run[at - start + 1 :]
        at //= ARITY


def _folded(node: str, place: int, others: list[str]) -> str:
    return _hash([*others[:place], node, *others[place:]])


def _tops(pdf: pd.DataFrame, depth: int) -> pd.DataFrame:
    """The top of each tree part of a superblock."""
    rows = [
        (g, block, total, reduced(one.sort_values("pos")["node"].tolist(), total, depth)[-1][0])
        for (g, block, total), one in pdf.groupby(["g", "block", "total"])
    ]
    return pd.DataFrame(rows, columns=["g", "block", "total", "node"])


def _way(outer: pd.DataFrame) -> dict[str, list[tuple[int, list[str]]]]:
    """For each group, its outer levels from the lowest up."""
    found = {}
    for g, one in outer.groupby("g"):
        one = one.sort_values("level")
        found[g] = [(p, [x[i : i + 64] for i in range(0, len(x), 64)]) for p, x in zip(one["place"].tolist(), one["others"].tolist())]
    return found


def _paths(inner: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    """What each node of a superblock needs from outside of it: a row for each level up to the root."""
    above, out = _way(outer), []
    for (g, total), one in inner.groupby(["g", "total"]):
        one = one.sort_values("pos")
        levels = reduced(one["node"].tolist(), total, depth)
        for at, pos in enumerate(one["pos"].tolist()):
            way = [*siblings(levels, at), *above.get(g, [])]
            out += [(g, pos, k, place, "".join(others)) for k, (place, others) in enumerate(way)]
    return pd.DataFrame(out, columns=["g", "pos", "level", "place", "others"])


def _proofs(inner: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    """Leaves with the hash of their proof, and what they fold to after tampering."""
    above, out = _way(outer), []
    for (g, total), one in inner.groupby(["g", "total"]):
        one = one.sort_values("pos")
        nodes = one["node"].tolist()
        levels, far = reduced(nodes, total, depth), above.get(g, [])
        tail = "".join("".join(others) for _, others in far)
        for at, (doc_id, node, changed) in enumerate(zip(one["doc_id"].tolist(), nodes, one["changed"].tolist())):
            digest, now = hashlib.sha256(), changed or node
            for place, others in siblings(levels, at):
                digest.update("".join(others).encode())
                now = _folded(now, place, others)
            digest.update(tail.encode())
            for place, others in far:
                now = _folded(now, place, others)
            out.append((doc_id, g, node, digest.hexdigest(), now))
    made = pd.DataFrame(out, columns=["doc_id", "g", "leaf", "proof_sha256", "folded_root"])
    return made.astype({"doc_id": "Int64"})


_PATH = "g string, pos bigint, level int, place int, others string"
_PROOF = "doc_id bigint, g string, leaf string, proof_sha256 string, folded_root string"


def _homes(nodes: DataFrame, span: int) -> DataFrame:
    """Nodes with ``block``, and ``home``, the superblock: a part of a large tree, or many whole small ones."""
    small = nodes.filter((F.col("total") <= span) & (F.col("pos") == 0)).agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    shared = max(1, -(-small // span))
    block = F.floor(F.col("pos") / span).cast("bigint")
    home = F.when(F.col("total") <= span, F.concat(F.lit("*"), F.pmod(F.xxhash64("g"), F.lit(shared)).cast("string"))).otherwise(F.concat(F.col("g"), F.lit("/"), block.cast("string")))
    return nodes.withColumn("block", block).withColumn("home", home)


def storeys(nodes: DataFrame, depth: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The storeys of all trees, and their last nodes (g, node).

    ``nodes`` has g, pos, total and node.  A storey has the trees that have more than one node left; each is
    4,096 times smaller than the one below it.
    """
    span, levels, roots, current = ARITY**depth, [], None, nodes
    while True:
        current = materialize(_homes(current, span), "merkle-storey")
        levels.append(current)
        parts = current.select("home", "g", "pos", "total", "node", "block").groupBy("home")
        tops = materialize(parts.applyInPandas(lambda pdf: _tops(pdf, depth), "g string, block bigint, total bigint, node string"), "merkle-tops")
        ends = tops.filter(F.col("total") <= span).select("g", "node")
        roots = ends if roots is None else roots.unionByName(ends)
        more = tops.filter(F.col("total") > span)
        if more.isEmpty():
            return levels, roots
        current = more.select("g", F.col("block").alias("pos"), F.ceil(F.col("total") / span).cast("bigint").alias("total"), "node")


def outer_rows(levels: list[DataFrame], above: DataFrame | None, depth: int = LEVELS) -> DataFrame:
    """(home, g, level, place, others): what superblocks of the lowest storey need from outside.

    ``above`` has g, level, place and others for what lies over the roots of whole trees.
    """
    span, cols, outer = ARITY**depth, ["g", "level", "place", "others"], None
    for k in reversed(range(len(levels))):
        # trees that end in this storey get what lies over them; parts of larger ones the way of their top
        homes = levels[k].select("home", "g", "block", "total").distinct()
        rows = levels[k].sparkSession.createDataFrame([], "home string, g string, level int, place int, others string")
        if above is not None:
            rows = rows.unionByName(homes.filter(F.col("total") <= span).join(above, "g").select("home", *cols))
        if outer is not None:
            down = outer.withColumnRenamed("pos", "block")
            rows = rows.unionByName(homes.filter(F.col("total") > span).join(down, ["g", "block"]).select("home", *cols))
        rows = materialize(rows, "merkle-outer")
        if k == 0:
            return rows
        outer = materialize(paths(levels[k], rows, depth), "merkle-paths")


def paths(nodes: DataFrame, outer: DataFrame, depth: int = LEVELS) -> DataFrame:
    """The way of each node of a storey up to the root."""
    inner = nodes.select("home", "g", "pos", "total", "node")
    return inner.groupBy("home").cogroup(outer.groupBy("home")).applyInPandas(lambda a, b: _paths(a, b, depth), _PATH)


def manifest(docs: DataFrame, depth: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row."""
    group = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    own, changed = leaf(), leaf(text=tampered_text())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), group.alias("g"), own.alias("node"), F.nullif(changed, own).alias("changed"))
    # the place of a row in this table tells equal rows apart
    leaves = materialize(rows.withColumn("n", F.monotonically_increasing_id()), "merkle-leaves")
    levels, subroots = storeys(numbered(leaves, ["g"], ["doc_id", "node", "n"]).drop("n"), depth)

    sources = materialize(numbered(subroots, [], ["g"]), "merkle-sources")
    upper, tops = storeys(sources.select(F.lit("").alias("g"), "pos", "total", "node"), depth)
    root = tops.select("node").first()
    to_root = paths(upper[0], outer_rows(upper, None, depth), depth)
    named = sources.select("pos", F.col("g").alias("of"))
    above = materialize(to_root.join(named, "pos").select(F.col("of").alias("g"), "level", "place", "others"), "merkle-above")

    outer = outer_rows(levels, above, depth)
    inner = levels[0].select("home", "g", "pos", "total", "node", "changed", "doc_id")
    proved = inner.groupBy("home").cogroup(outer.groupBy("home")).applyInPandas(lambda a, b: _proofs(a, b, depth), _PROOF)
    rooted = join_bounded(proved, sources.select("g", F.col("node").alias("subroot")), ["g"])
    whole = F.lit(root[0] if root else None).cast("string")
    return rooted.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))
