"""Exact top-k search by inner product in an M-tree.

Components are turned into integers, floor(256 x).  With M the greatest length of a vector, a vector x is lifted
to (x, sqrt(M^2 - |x|^2)) and a query q to (q, 0); then d(q, x)^2 = |q|^2 + M^2 - 2 q.x is a metric distance, and
the nearest vectors have the highest scores.

Method.  The tree is paged: its root has a routing object for each subtree, a subtree one for each page of at most
64 vectors.  Every node keeps its covering radius, and nodes and vectors the distance to their parent, so that by
the triangle inequality many are passed over before their distance to the query is computed.  The subtrees are
made from the vectors nearest to each of a bounded sample of pivots, large ones in parts; every vector is in the
tree.  A query first goes to the subtree that it lies in, which gives a floor under its k-th score; blocks of
queries then meet the routing objects of the root, in chunks, and only subtrees that can hold a score at the floor
are searched, best page first, until the next page's bound is beyond the k-th distance.

Of equal vectors only the first k + 1 by vec_id can be in a result, as one may be the query's own row; further
ones are left out of the tree, and equal queries are searched once, so copies cost no more than they are.

Defined results: vectors that are null, or hold null or components that aren't finite, take no part; vectors meet
those of their own length only (empty ones score 0 with each other); rows with equal vec_id are told apart, so
the own row alone is left out; null ids ask nothing and are last among ties; scores beyond 64 bits count as the
nearest long; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .native import join_bounded
from .scratch import materialize

SCALE = 256
#: Vectors of a page, and of a subtree on average.
PAGE, SPAN = 64, 2048
#: Pivots at most, and the bytes that they may take.
PIVOTS, PIVOT_BYTES = 1024, 1 << 25
#: Queries of a block and routing objects of a chunk, on average.
BLOCK, CHUNK = 1024, 1024
#: Of lengths, what rounding may hide in a distance.
SLACK = 1e-6
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as fit them, behind a letter for their type."""
    most = np.abs(v).max(initial=0)
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "d"
    return kind.encode() + v.astype(f"<{np.dtype(kind).char}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<{chr(data[0])}", offset=1).astype(np.float64)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("v")
        offsets = column.offsets.to_numpy()
        values = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        there = np.asarray(column.is_valid())
        keep = np.flatnonzero(there & (odd[offsets[1:]] == odd[offsets[:-1]]))
        rows = [values[offsets[k] : offsets[k + 1]] for k in keep.tolist()]
        some = batch.take(pa.array(keep))
        made = {
            "rid": some.column("rid"), "vec_id": some.column("vec_id"), "asks": some.column("asks"), "dim": pa.array([len(v) for v in rows], pa.int32()),
            "code": pa.array([packed(v) for v in rows], pa.binary()), "square": pa.array([float(v @ v) for v in rows], pa.float64()),
        }
        yield pa.RecordBatch.from_pydict(made)


def integers(rows: DataFrame, asks: Column, vector: str = "embedding") -> DataFrame:
    """rid, vec_id, asks, dim, code and square of the vectors that take part."""
    given = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("v"))
    return given.mapInArrow(_integers, "rid bigint, vec_id bigint, asks boolean, dim int, code binary, square double")


def _apart(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - one) ** 2).sum(axis=1))


def pages(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in halves of halves, each between two that lie far apart, until ``most`` are together."""
    left, out = [np.arange(len(points))], []
    while left:
        own = left.pop()
        if len(own) <= most:
            out.append(own)
            continue
        here = points[own]
        a = here[np.argmax(_apart(here, here.mean(axis=0)))]
        from_a = _apart(here, a)
        b = here[np.argmax(from_a)]
        order = np.argsort(from_a - _apart(here, b), kind="stable")
        left += [own[order[len(own) // 2 :]], own[order[: len(own) // 2]]]
    return out


_TREE = "tree string, dim int, center binary, radius double, rids binary, ids binary, absent binary, vectors binary, starts binary, routers binary, radii binary, parents binary, entries binary, asking binary"
_ARRAYS = {"rids": "<i8", "ids": "<i8", "absent": "?", "starts": "<i8", "routers": "<i8", "radii": "<f8", "parents": "<f8", "entries": "<f8", "asking": "<i8"}


def subtree(pdf: pd.DataFrame, most: float) -> dict:
    """A subtree of the vectors of ``pdf``; ``most`` is the square of M."""
    dim = int(pdf["dim"].iloc[0])
    pdf = pdf.sort_values("rid")
    vectors = np.array([unpacked(x) for x in pdf["code"]]).reshape(len(pdf), dim)
    lift = np.sqrt(np.maximum(0, most - pdf["square"].to_numpy()))
    points = np.column_stack([vectors, lift])
    parts = pages(points, PAGE)
    order = np.concatenate(parts)
    points = points[order]
    middle = int(np.argmin(_apart(points, points.mean(axis=0))))
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    routers, radii, entries = [], [], []
    for a, b in zip(starts[:-1], starts[1:]):
        here = points[a:b]
        router = int(np.argmin(_apart(here, here.mean(axis=0))))
        entries.append(_apart(here, here[router]))
        routers.append(a + router)
        radii.append(entries[-1].max())
    pdf = pdf.iloc[order]
    made = {
        "rids": pdf["rid"], "ids": pdf["vec_id"].fillna(0), "absent": pdf["vec_id"].isna(), "starts": starts, "routers": routers, "radii": radii,
        "parents": _apart(points[routers], points[middle]), "entries": np.concatenate(entries), "asking": np.flatnonzero(pdf["asks"].to_numpy()),
    }
    return {
        "tree": pdf["tree"].iloc[0], "dim": dim, "center": packed(points[middle, :-1]), "radius": float(_apart(points, points[middle]).max()),
        "vectors": packed(points[:, :-1].ravel()), **{k: np.asarray(v).astype(_ARRAYS[k]).tobytes() for k, v in made.items()},
    }


class Subtree:
    """A row of the tree, open for search."""

    def __init__(self, row: dict, most: float):
        self.most, self.center, self.radius = most, unpacked(row["center"]), row["radius"]
        for name, kind in _ARRAYS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.vectors = unpacked(row["vectors"]).reshape(len(self.rids), row["dim"])
        self.routing = self.vectors[self.routers]
        self.greatest = np.abs(self.vectors).max(initial=0)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> list[int]:
        if self.greatest * np.abs(q).max(initial=0) * max(1, len(q)) < _EXACT:
            return (self.vectors[rows] @ q).astype(np.int64).tolist()
        whole = [int(x) for x in q]
        exact = (sum(int(a) * b for a, b in zip(v.tolist(), whole)) for v in self.vectors[rows])
        return [max(-_LONG - 1, min(_LONG, s)) for s in exact]

    def search(self, q: np.ndarray, k: int, floor: float | None) -> list[tuple]:
        """The k best (-score, id is null, id, row) with scores from ``floor`` on, which k vectors are known to reach."""
        square = float(q @ q)
        slack = SLACK * (np.sqrt(square) + np.sqrt(self.most))
        far = lambda dot: np.sqrt(np.maximum(0, square + self.most - 2 * dot))
        reach = np.inf if floor is None else far(floor) + slack
        best: list[tuple] = []
        # by the distances to the subtree's own routing object, before those to the pages' are computed
        some = np.flatnonzero(~(np.abs(far(self.center @ q) - self.parents) - self.radii > reach))
        apart = far(self.routing[some] @ q)
        bound = apart - self.radii[some]
        for at in np.argsort(bound, kind="stable").tolist():
            if bound[at] > reach:
                break
            page = some[at]
            rows = np.arange(self.starts[page], self.starts[page + 1])
            rows = rows[~(np.abs(apart[at] - self.entries[rows]) > reach)]
            if not len(rows):
                continue
            scores = self.scores(rows, q)
            least = -best[-1][0] if len(best) == k else floor
            new = [(-s, bool(self.absent[r]), int(self.ids[r]), r) for s, r in zip(scores, rows.tolist()) if least is None or s >= least]
            if new:
                best = sorted(best + new)[:k]
                if len(best) == k:
                    reach = min(reach, far(float(-best[-1][0])) + slack)
        return best


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _below(score: int) -> float:
    """A double that isn't above a score."""
    return float(score) if abs(score) < _EXACT else float(score) - abs(float(score)) * 1e-15


def tree(vectors: DataFrame, most: float) -> DataFrame:
    """The M-tree of vectors with rid, vec_id, asks, dim, code and square: a row for each subtree."""
    n, dims = vectors.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    pivots = max(1, min(PIVOTS, PIVOT_BYTES // (8 * max(1, dims)), -(-n // SPAN)))
    hashed = vectors.withColumn("h", F.xxhash64("dim", "code"))
    cut = hashed.select("h").distinct().orderBy("h").limit(pivots).agg(F.max("h")).first()[0]
    sample = [] if cut is None else hashed.filter(F.col("h") <= cut).dropDuplicates(["h"]).select("dim", "code").collect()
    known: dict[int, list] = {}
    for r in sorted(sample, key=lambda r: (r["dim"], bytes(r["code"]))):
        known.setdefault(r["dim"], []).append(unpacked(bytes(r["code"])))
    shared = vectors.sparkSession.sparkContext.broadcast({d: np.array(v).reshape(len(v), d) for d, v in known.items()})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, codes = batch.column("dim").to_numpy(), batch.column("code").to_pylist()
            home = np.full(len(codes), -1)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in shared.value:
                    own = np.array([unpacked(codes[k]) for k in at.tolist()]).reshape(len(at), dim)
                    to = shared.value[dim]
                    lift = np.sqrt(np.maximum(0, most - (to**2).sum(axis=1)))
                    height = np.sqrt(np.maximum(0, most - (own**2).sum(axis=1)))
                    home[at] = np.argmin(-2 * (own @ to.T + np.outer(height, lift)), axis=1)
            yield batch.append_column("home", pa.array(home, pa.int32()))

    columns = "rid bigint, vec_id bigint, asks boolean, dim int, code binary, square double"
    placed = materialize(vectors.mapInArrow(near, f"{columns}, home int"), "metric-homes")
    sizes = materialize(placed.groupBy("dim", "home").agg(F.ceil(F.count("*") / SPAN).cast("int").alias("parts")), "metric-sizes")
    parted = join_bounded(placed, sizes, ["dim", "home"])
    name = F.concat_ws("/", "dim", "home", F.pmod(F.xxhash64("rid"), F.col("parts")))
    grouped = parted.select("rid", "vec_id", "asks", "dim", "code", "square", name.alias("tree")).groupBy("tree")
    names = [c.split(" ")[0] for c in _TREE.split(", ")]
    return grouped.applyInPandas(lambda pdf: pd.DataFrame([subtree(pdf.astype({"vec_id": "Int64"}), most)])[names], _TREE)


def search(rows: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` best of each row for which ``asks`` holds."""
    vectors = materialize(integers(rows, asks), "metric-vectors")
    most = float(vectors.agg(F.max("square")).first()[0] or 0)
    first = F.row_number().over(Window.partitionBy("dim", "code").orderBy(F.col("vec_id").asc_nulls_last(), "rid"))
    asked = vectors.filter("asks AND vec_id IS NOT NULL").select("rid", "vec_id", "dim", "code")
    some = vectors.drop("asks").withColumn("place", first).filter(F.col("place") <= k + 1)
    flags = asked.select("dim", "code").distinct().withColumn("seeks", F.lit(True))
    some = some.join(flags, ["dim", "code"], "left")
    some = some.select("rid", "vec_id", (F.coalesce("seeks", F.lit(False)) & (F.col("place") == 1)).alias("asks"), "dim", "code", "square")
    trees = materialize(tree(materialize(some, "metric-candidates"), most), "metric-tree")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            own = Subtree(row, most)
            codes, least = [], []
            for at in own.asking.tolist():
                q = own.vectors[at]
                found = own.search(q, k + 1, None)
                codes.append(packed(q))
                least.append(_below(-found[-1][0]) if len(found) == k + 1 else None)
            made = [pa.array([row["dim"]] * len(codes), pa.int32()), pa.array(codes, pa.binary()), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays(made, names=["dim", "code", "floor"])

    queries = materialize(trees.mapInArrow(floors, "dim int, code binary, floor double"), "metric-queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("dim", "code"), F.lit(blocks)).cast("int")
    packs = materialize(queries.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("code", "floor")).alias("queries")), "metric-blocks")
    chunks = max(1, -(-trees.count() // CHUNK))
    chunk = F.pmod(F.xxhash64("tree"), F.lit(chunks)).cast("int")
    root = trees.groupBy("dim", chunk.alias("chunk")).agg(F.collect_list(F.struct("tree", "center", "radius")).alias("nodes"))

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            dim = row["dim"]
            q = np.array([unpacked(x["code"]) for x in row["queries"]]).reshape(len(row["queries"]), dim)
            c = np.array([unpacked(x["center"]) for x in row["nodes"]]).reshape(len(row["nodes"]), dim)
            square = (q**2).sum(axis=1)
            floor = np.array([-np.inf if x["floor"] is None else x["floor"] for x in row["queries"]])
            reach = np.sqrt(np.maximum(0, square + most - 2 * floor)) + SLACK * (np.sqrt(square) + np.sqrt(most))
            apart = np.sqrt(np.maximum(0, square[:, None] + most - 2 * (q @ c.T)))
            stay = ~(apart - np.array([x["radius"] for x in row["nodes"]]) > reach[:, None])
            at = [np.flatnonzero(s).tolist() for s in stay.T]
            live = [j for j, x in enumerate(at) if x]
            made = [pa.array([dim] * len(live), pa.int32()), pa.array([row["block"]] * len(live), pa.int32()), pa.array([row["nodes"][j]["tree"] for j in live], pa.string()), pa.array([at[j] for j in live], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, names=["dim", "block", "tree", "wanted"])

    every = packs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    pairs = materialize(every.join(root, ["dim", "chunk"]).mapInArrow(pruned, "dim int, block int, tree string, wanted array<int>"), "metric-pairs")
    sent = pairs.join(packs, ["dim", "block"]).select("tree", F.transform("wanted", lambda i: F.get("queries", i)).alias("queries"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            own, out = Subtree(row, most), []
            for asked_ in row["queries"]:
                for s, absent, vec_id, at in own.search(unpacked(asked_["code"]), k + 1, asked_["floor"]):
                    out.append((row["dim"], asked_["code"], int(own.rids[at]), None if absent else vec_id, -s))
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            made = [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(made, names=["dim", "code", "found", "vec_id", "score"])

    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "found"]
    hits = sent.join(trees, "tree").mapInArrow(found, "dim int, code binary, found bigint, vec_id bigint, score bigint")
    hits = hits.withColumn("place", F.row_number().over(Window.partitionBy("dim", "code").orderBy(*order))).filter(F.col("place") <= k + 1).drop("place")
    each = asked.withColumnRenamed("vec_id", "query_id").join(hits, ["dim", "code"]).filter("rid <> found")
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
