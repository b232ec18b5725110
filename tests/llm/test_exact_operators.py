"""Exact search, the manifest and ranked search against plain versions, with odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import merkle, metric, ranked

#: Names that the operators use for columns of their own.
CLASHES = ["n", "g", "code", "dim", "root", "mark", "term", "bound"]

# 11. exact top-k search


def clamped(score):
    return max(-(2**63), min(2**63 - 1, score))


def nearest(rows, every, k=5):
    """query_id, rank, vec_id, score by all pairs, in whole numbers of any size."""
    kept = [(i, v, [math.floor(256 * float(x)) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, q in kept:
        if v is None or v % every:
            continue
        scored = [(-clamped(sum(a * b for a, b in zip(q, x))), w is None, w or 0) for j, w, x in kept if j != i and len(x) == len(q)]
        out += [(v, n + 1, None if absent else w, -s) for n, (s, absent, w) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def vectors(spark, rows):
    schema = "vec_id bigint, embedding array<float>, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], schema)


def as_floats(rows):
    return [(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for v, e in rows]


@pytest.mark.parametrize("page, span", [(64, 2048), (4, 16)])
def test_search_equals_all_pairs(spark, monkeypatch, page, span):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8))
    rows = [(int(k), [float(x) for x in (centers[k % 6] + 0.1 * rng.normal(size=8)) / 3]) for k in range(240)]
    hot = rows[7][1]
    rows += [(1000 + k, hot) for k in range(150)] + [(10, rows[3][1]), (10, rows[3][1]), (None, hot), (None, None), (20, None)]
    rows += [(30, [None] + hot[1:]), (40, [float("nan")] + hot[1:]), (50, [float("inf")] + hot[1:]), (60, []), (61, []), (70, [0.5, -0.25]), (71, [0.1, 0.0]), (72, [0.0] * 8)]
    monkeypatch.setattr(metric, "SPAN", span)
    got = metric.search(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == nearest(as_floats(rows), 10)


def test_search_with_scores_beyond_doubles(spark):
    rows = [(k, [1e9 * (k % 7 - 3), 3.5e8 + k, -1e7 * k]) for k in range(40)] + [(100, [3e38, 1.0, 0.0]), (110, [3e38, 0.0, 2.0])]
    got = metric.search(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == nearest(as_floats(rows), 10)


def test_search_of_nothing(spark):
    assert metric.search(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert metric.search(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []


def test_pages_are_balanced_and_subtrees_pass_over_pages():
    import pandas as pd

    rng = np.random.default_rng(1)
    points = np.floor(np.concatenate([rng.normal(c, 3, size=(64, 4)) for c in (0, 2000, -2000, 4000)]))
    assert max(len(p) for p in metric.pages(points, 64)) <= 64
    most = float((points**2).sum(axis=1).max())
    pdf = pd.DataFrame({"rid": range(len(points)), "vec_id": range(len(points)), "asks": False, "dim": 4, "code": [metric.packed(p) for p in points], "square": (points**2).sum(axis=1), "tree": "t"})
    opened = metric.Subtree(metric.subtree(pdf.astype({"vec_id": "Int64"}), most), most)
    counted = []
    whole = opened.scores
    opened.scores = lambda rows, q: counted.append(len(rows)) or whole(rows, q)
    q = points[200]
    found = opened.search(q, 5, None)
    assert [-s for s, *_ in found] == sorted((points @ q).astype(int), reverse=True)[:5]
    assert sum(counted) <= len(points) / 2


# 12. Merkle manifest


def plain_manifest(rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), len(by[r["source"]]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:4])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for at, (_, _, own, _, r) in enumerate(sorted(by[s], key=lambda x: x[:4])):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            now, proof = leaf(r, text), ""
            for levels, k in ((trees[s], at), (top, place)):
                for level in levels[:-1]:
                    start = k - k % 16
                    run = level[start : start + 16]
                    proof += "".join(run[: k - start] + run[k - start + 1 :])
                    now = sha("".join([*run[: k - start], now, *run[k - start + 1 :]]))
                    k //= 16
            root = top[-1][0]
            out.append((r["doc_id"], own, trees[s][-1][0], root, sha(proof), now, now == root))
    return sorted(out, key=repr)


def sized(docs):
    return docs.withColumns({"n_chars": F.length("text").cast("bigint"), "root": F.lit("r"), "g": F.lit(1)})


@pytest.mark.parametrize("depth", [3, 1])
def test_manifest_equals_plain(spark, odd, depth):
    """With superblocks of 16 leaves, a source of 600 has three storeys."""
    docs = sized(odd)
    more = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text Of "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    many = spark.range(40).select((F.col("id") % 3).alias("doc_id"), F.lit("Same").alias("text"), F.concat(F.lit("sé"), F.col("id").cast("string")).alias("source"))
    docs = docs.unionByName(more, allowMissingColumns=True).unionByName(many, allowMissingColumns=True)
    got = sorted((tuple(r) for r in merkle.manifest(docs, depth).collect()), key=repr)
    assert got == plain_manifest([r.asDict() for r in docs.collect()])
    assert any(not r[-1] for r in got)


def test_manifest_of_little(spark, odd):
    docs = sized(odd)
    assert merkle.manifest(docs.limit(0)).collect() == []
    one = docs.filter("doc_id = 1")
    (row,) = merkle.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == hashlib.sha256(b"").hexdigest()


# 13. ranked search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=20):
    bags = [(i, collections.Counter(words(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked = collections.Counter(words(text))
        scored = []
        for i, bag, n in bags:
            m = 75 + 25 * n * n_docs // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t, q in asked.items() if t in bag
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if absent else i, -s) for rank, (s, absent, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "Alpha beta BETA p3 p4"), (2, None), (3, ""), (4, "nowhere else"), (4, "x été 中文"), (5, "w1x1 w2x2 w3x3 alpha"), (None, "same line 12"), (6, "the"), (7, "the the rare0 rare5")]


@pytest.mark.parametrize("pack_terms", [1 << 16, 4])
def test_ranked_search_equals_plain(spark, odd, documents, pack_terms):
    docs = documents.select("doc_id", "text").collect()
    common = [(5000 + k, "the " * (k % 40) + f"rare{k % 9} " * (k % 11 == 0) + "filler " * (k % 5)) for k in range(300)]
    copies = [(9000, "the rare0 copy")] * 40
    rows = [tuple(r) for r in docs] + common + copies + [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = ITEMS + [(100 + k, " ".join(words(docs[k]["text"])[:30])) for k in range(8)]
    frame = spark.createDataFrame([(*r, *CLASHES) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    asked = spark.createDataFrame([(*r, "a") for r in items], "item_id bigint, text string, row string")
    got = ranked.search(frame.repartition(5), asked, pack_terms=pack_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(rows, items)


def test_ranked_search_of_nothing(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = odd.select("doc_id", "text")
    assert ranked.search(docs.limit(0), items).collect() == []
    assert ranked.search(docs, items.limit(0)).collect() == []


def test_bounds_are_never_below_scores(documents):
    import pyarrow as pa

    texts = [r["text"] or "" for r in documents.limit(60).collect()]
    block = ranked._Block()
    for k, text in enumerate(texts):
        _, hashes = ranked.hashed(pa.array([text]))
        _, own, times = ranked._counted(np.zeros(len(hashes), int), hashes)
        keys = np.concatenate([ranked._tier_keys(own[times >= t], j) for j, t in enumerate(ranked.TIERS)]) if len(own) else np.zeros(0, np.uint64)
        block.add(k, k, len(hashes), keys)
    ids, marks, sizes, width, slices = block.row()
    asked = [(j, w, n) for j in range(10) for w, n in collections.Counter(ranked.terms(texts[j])).items()]
    hashes = ranked.hashed(pa.array([w for _, w, _ in asked], pa.large_binary()))[1].view(np.int64).tolist()
    rows = [{"row": j, "item_id": j, "term": w, "hash": h, "times": n} for (j, w, n), h in zip(asked, hashes)]
    pack = ranked.Pack(rows, dict.fromkeys(hashes, 3), len(texts), sum(sizes))
    bound = pack.bounds({"sizes": sizes, "slices": slices, "width": width})
    exact = np.array([pack.scores(t, list(range(len(pack.rows)))) for t in texts]).T
    assert (bound >= exact).all()
    assert (bound[exact == 0] == 0).mean() > 0.9
