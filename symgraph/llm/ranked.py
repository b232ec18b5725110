"""Ranked lexical search over bit-sliced Bloom signatures.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.  A term's
weight is floor(1000 ln((2 N + 2) / (2 df + 1))), and a document's score for an item is the sum over the item's
terms, repeats included, of weight * ((10^9 tf) div (1000 tf + 12 m)), m = 75 + (25 n N) div L.

Method.  Documents of like length share a block.  A document's signature is a Bloom filter of its terms, each at
every tier of frequency that it reaches (at least 1, 2, 3, 4, 6, 8, ... times).  A block stores signatures by
slices: a slice is one bit of all its documents.  For a term the slices of its bits are ANDed: the bitmap that is
left has every document with the term, and a few more.  The highest tier left bounds tf from above, so weighted
sums of slices bound scores from above.  A first pass takes the documents with the highest bounds and scores them exactly; the 20th best of
these scores is an item's floor.  A second pass keeps every document whose bound reaches the floor, and only
those, which can't be excluded, are scored exactly from their texts.

The items are taken in packs of a bounded number of terms; a pack is what is broadcast.  Terms are told apart by
64-bit hashes when they are counted and sought; exact scores come from the terms themselves.

Defined results: a null or empty text has no terms; items without terms, or whose terms no document has, have
no rows; rows with equal ids are ranked one by one, ties among them being arbitrary as their rows are equal but
for rank; of ties a null id comes last; items with equal item_id are ranked one by one; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import _BYTE_BASE, _BYTE_VALUE, U64, _span_hash, mix, steps
from .scratch import materialize

#: Bits of a signature for each of its keys, and bits that a key sets: about one false key in 5,000.
BITS_PER_KEY, PROBES = 20, 7
#: Least frequencies of the tiers; the last has no upper end.
TIERS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 4096, 1 << 14, 1 << 17, 1 << 20])
#: Documents of a block, and bits of one at most, unless eight documents have more.
BLOCK_DOCS, BLOCK_BITS = 512, 1 << 23
#: Bits of a signature at most; beyond that more of its keys are false, and more documents are scored.
MOST_BITS = 1 << 24
#: Terms and items of a pack, on average, and cells of a table of sums.
PACK_TERMS, PACK_ITEMS, CELLS = 1 << 16, 1 << 12, 1 << 22
#: Documents with the highest bounds that are scored to find an item's floor.
TRIED = 48
#: Rows of candidates that are broadcast at most.
BROADCAST_ROWS = 200_000
LEAST_TEXT = 75
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def terms(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode().lower())


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each term of a column of texts."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data, offsets = _LOWER[whole[offsets[0] : offsets[-1]]], offsets - offsets[0]
    n, solid = len(data), _IN_TERM[data]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    first[inner] = solid[inner]
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text_of = np.searchsorted(offsets, starts, "right") - 1
    return text_of, _span_hash(_BYTE_VALUE[data], _BYTE_BASE, starts, ends)


def _counted(text_of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of the different terms of each text."""
    order = np.lexsort((hashes, text_of))
    t, h = text_of[order], hashes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return t[at], h[at], np.diff(np.append(at, len(t)))


def _tier_keys(hashes: np.ndarray, tier: int) -> np.ndarray:
    return mix(hashes ^ mix(np.array([tier + 1], U64)))


def _rows(keys: np.ndarray, width: int) -> np.ndarray:
    """The bits of each key: PROBES columns."""
    step = (keys >> U64(32)) | U64(1)
    return ((keys[:, None] + step[:, None] * np.arange(PROBES, dtype=U64)) % U64(width)).astype(np.int64)


class _Block:
    """Documents of like length, until there are enough of them for a block."""

    def __init__(self):
        self.ids, self.marks, self.sizes, self.keys, self.most = [], [], [], [], 0

    def add(self, doc_id: int | None, mark: int, size: int, keys: np.ndarray) -> bool:
        self.ids.append(doc_id)
        self.marks.append(mark)
        self.sizes.append(size)
        self.keys.append(keys)
        self.most = max(self.most, len(keys))
        n = len(self.ids)
        return n >= BLOCK_DOCS or n % 8 == 0 and (n + 8) * self.most * BITS_PER_KEY > BLOCK_BITS

    def row(self) -> tuple:
        width, n = min(MOST_BITS, max(64, self.most * BITS_PER_KEY)), len(self.ids)
        bits = np.zeros((width, -(-n // 8) * 8), bool)
        bits[_rows(np.concatenate(self.keys), width), np.repeat(np.arange(n), [len(k) for k in self.keys])[:, None]] = True
        return self.ids, self.marks, self.sizes, width, np.packbits(bits, axis=1).tobytes()


_INDEX = pa.schema(
    [
        ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("width", pa.int64()), ("slices", pa.binary()),
        ("terms", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int64())),
    ]
)
_INDEX_DDL = "ids array<bigint>, marks array<bigint>, sizes array<bigint>, width bigint, slices binary, terms array<bigint>, dfs array<bigint>"


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and mark, a hash of the text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))


def build(docs: DataFrame, wanted: np.ndarray, signatures: bool = True) -> DataFrame:
    """The index: a row for each block, and for each task one with the frequencies of the ``wanted`` terms (sorted hashes).

    Without ``signatures`` only frequencies are counted.
    """
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, open_ = known.value, {}
        dfs = np.zeros(len(wanted), np.int64)
        batch_of = lambda rows: pa.RecordBatch.from_pylist([dict(zip(_INDEX.names, r)) for r in rows], schema=_INDEX)
        for batch in batches:
            texts = batch.column("text")
            for at, to in steps(texts):
                text_of, hashes = hashed(texts.slice(at, to - at))
                sizes = np.bincount(text_of, minlength=to - at)
                t, h, times = _counted(text_of, hashes)
                if len(wanted):
                    place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    dfs += np.bincount(place[wanted[place] == h], minlength=len(wanted))
                if not signatures:
                    continue
                keys, of, tier = [], [], 0
                while len(h):
                    keys.append(_tier_keys(h, tier))
                    of.append(t)
                    tier += 1
                    more = times >= TIERS[tier] if tier < len(TIERS) else np.zeros(len(h), bool)
                    t, h, times = t[more], h[more], times[more]
                if not keys:
                    continue
                keys, of = np.concatenate(keys), np.concatenate(of)
                order = np.argsort(of, kind="stable")
                keys, bounds = keys[order], np.searchsorted(of[order], np.arange(to - at + 1))
                ids, marks = batch.column("doc_id")[at:to].to_pylist(), batch.column("mark")[at:to].to_pylist()
                for k in np.flatnonzero(sizes).tolist():
                    own = keys[bounds[k] : bounds[k + 1]]
                    like = int(2 * math.log2(len(own)))
                    block = open_.setdefault(like, _Block())
                    if block.add(ids[k], marks[k], int(sizes[k]), own):
                        yield batch_of([(*open_.pop(like).row(), [], [])])
        for block in open_.values():
            yield batch_of([(*block.row(), [], [])])
        if seen := np.flatnonzero(dfs).tolist():
            yield batch_of([([], [], [], 0, b"", wanted[seen].view(np.int64).tolist(), dfs[seen].tolist())])

    return marked(docs).mapInArrow(run, _INDEX_DDL)


def asked(items: DataFrame) -> DataFrame:
    """row, item_id, term (its bytes), hash and times for each different term of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, item, term, times = [], [], [], []
            for r, i, text in zip(batch.column("row").to_pylist(), batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in Counter(terms(text)).items():
                    row.append(r)
                    item.append(i)
                    term.append(word)
                    times.append(n)
            texts = pa.array(term, pa.large_binary())
            hashes = hashed(texts)[1].view(np.int64) if term else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(item, pa.int64()), texts.cast(pa.binary()), pa.array(hashes), pa.array(times, pa.int64())], names=["row", "item_id", "term", "hash", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("bigint").alias("item_id"), "text")
    return rows.mapInArrow(run, "row bigint, item_id bigint, term binary, hash bigint, times bigint")


class Pack:
    """Items whose terms are sought together: for each term of each item its weight times its repeats."""

    def __init__(self, rows: list, dfs: dict[int, int], documents: int, total: int):
        self.documents, self.total = documents, total
        self.hashes = np.unique(np.array([r["hash"] for r in rows], np.int64)).view(U64)
        self.hashes.sort()
        place = {int(h): k for k, h in enumerate(self.hashes.view(np.int64))}
        weight = lambda df: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        rows = [r for r in rows if dfs.get(r["hash"])]
        rows.sort(key=lambda r: r["row"])
        self.rows = sorted({r["row"] for r in rows})
        number = {row: k for k, row in enumerate(self.rows)}
        self.item_ids = [None] * len(self.rows)
        self.item = np.array([number[r["row"]] for r in rows], np.int64)
        self.term = np.array([place[r["hash"]] for r in rows], np.int64)
        self.weight = np.array([weight(dfs[r["hash"]]) * r["times"] for r in rows], np.float64)
        self.starts = np.searchsorted(self.item, np.arange(len(self.rows)))
        self.exact: list[dict[bytes, int]] = [{} for _ in self.rows]
        for r in rows:
            k = number[r["row"]]
            self.item_ids[k] = r["item_id"]
            self.exact[k][bytes(r["term"])] = weight(dfs[r["hash"]]) * r["times"]

    def length(self, n):
        return LEAST_TEXT + (25 * n * self.documents) // self.total

    def bounds(self, block: dict) -> np.ndarray:
        """Upper bounds of the scores, a row for each item, a column for each document of a block."""
        n = np.array(block["sizes"], np.int64)
        slices = np.frombuffer(block["slices"], np.uint8).reshape(block["width"], -1)
        m = self.length(n)
        tiers = np.zeros((len(self.hashes), len(n)), np.int8)
        left, present = np.arange(len(self.hashes)), None
        for k in range(len(TIERS)):
            hit = np.bitwise_and.reduce(slices[_rows(_tier_keys(self.hashes[left], k), block["width"])], axis=1)
            present = hit if present is None else present & hit
            some = present.any(axis=1)
            left, present = left[some], present[some]
            if not len(left):
                break
            tiers[left] += np.unpackbits(present, axis=1)[:, : len(n)].view(np.int8)
        most = np.append(np.append(0, TIERS[1:] - 1), 1 << 62)
        part = np.zeros((len(TIERS) + 1, len(n)))
        for k in range(1, len(TIERS) + 1):
            tf = np.minimum(most[k], n)
            part[k] = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
        out = np.zeros((len(self.rows), len(n)))
        live = np.flatnonzero(tiers.any(axis=1)[self.term])
        for some in np.array_split(live, len(live) * len(n) // CELLS + 1) if len(live) else ():
            term, item = self.term[some], self.item[some]
            sums = part[tiers[term], np.arange(len(n))] * self.weight[some][:, None]
            at = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
            out[item[at]] += np.add.reduceat(sums, at, axis=0)
        return out

    def scores(self, text: str, items: list[int]) -> list[int]:
        found = terms(text)
        times, m = Counter(found), self.length(len(found))
        part = {}
        out = []
        for k in items:
            score = 0
            for term, weight in self.exact[k].items():
                if tf := times.get(term):
                    if term not in part:
                        part[term] = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
                    score += weight * part[term]
            out.append(score)
        return out


_HITS = "item bigint, doc_id bigint, mark bigint, bound double"


def _hits(item: list, ids: list, marks: list, bound: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(bound, pa.float64())], names=["item", "doc_id", "mark", "bound"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in ("ids", "marks", "sizes", "width", "slices")}
            yield {c: v.as_py() if c != "slices" else v.as_buffer() for c, v in row.items()}


def highest(index: DataFrame, pack, k: int) -> DataFrame:
    """The documents with the highest bounds of each item: as many as ``k`` from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for block in _blocks(batches):
            bound = pack.value.bounds(block)
            place = np.arange(bound.shape[1])
            if bound.shape[1] > k:
                place = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                bound = np.take_along_axis(bound, place, axis=1)
            place = np.broadcast_to(place, bound.shape)
            ids = np.array([-1 if x is None else x for x in block["ids"]], np.int64)[place]
            absent = np.array([x is None for x in block["ids"]])[place]
            new = [bound, ids, np.array(block["marks"], np.int64)[place], absent]
            best = new if best is None else [np.concatenate(x, axis=1) for x in zip(best, new)]
            if best[0].shape[1] > 2 * k:
                keep = np.argpartition(-best[0], k - 1, axis=1)[:, :k]
                best = [np.take_along_axis(x, keep, axis=1) for x in best]
        if best is not None:
            item, at = np.nonzero(best[0] > 0)
            bound, ids, marks, absent = (x[item, at] for x in best)
            yield _hits(item.tolist(), [None if a else i for i, a in zip(ids.tolist(), absent.tolist())], marks.tolist(), bound.tolist())

    return index.mapInArrow(run, _HITS)


def reaching(index: DataFrame, pack, floors) -> DataFrame:
    """Every document whose bound reaches the floor of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.maximum(floors.value, 1)[:, None]
        for block in _blocks(batches):
            bound = pack.value.bounds(block)
            item, at = np.nonzero(bound >= least)
            if len(item):
                ids, marks, at = block["ids"], block["marks"], at.tolist()
                yield _hits(item.tolist(), [ids[k] for k in at], [marks[k] for k in at], bound[item, at].tolist())

    return index.mapInArrow(run, _HITS)


def scored(docs: DataFrame, hits: DataFrame, pack) -> DataFrame:
    """item, doc_id and exact score of the documents of ``hits``, each row of them."""
    wanted = materialize(hits.groupBy("doc_id", "mark").agg(F.collect_set("item").alias("items")), "ranked-candidates")
    few = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    own = marked(docs)
    on = own["doc_id"].eqNullSafe(wanted["__id"]) & (own["mark"] == wanted["__mark"])
    found = own.join(F.broadcast(wanted) if few else wanted, on).select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, ids, score = [], [], []
            for doc_id, text, items in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("items").to_pylist()):
                item += items
                ids += [doc_id] * len(items)
                score += pack.value.scores(text.as_py(), items)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return found.mapInArrow(run, "item bigint, doc_id bigint, score bigint").filter("score > 0")


def _top(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, pack_terms: int = PACK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    words = materialize(asked(items), "ranked-terms")
    n_terms, n_items = words.agg(F.count("*"), F.count_distinct("row")).first()
    packs = max(1, -(-n_terms // pack_terms), -(-n_items // PACK_ITEMS))
    dealt = words.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(packs)))
    out, index, size = None, None, None
    for number in range(packs):
        rows = dealt.filter(F.col("pack") == number).drop("pack").collect()  # about pack_terms of them
        wanted = np.unique(np.array([r["hash"] for r in rows], np.int64).view(U64))
        counted = materialize(build(docs, wanted, index is None), "ranked-index" if index is None else "ranked-counts")
        if index is None:
            index = counted.filter("width > 0")
            size = index.select(F.size("ids").alias("n"), F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
        dfs = counted.filter("width = 0").select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
        found = {r["terms"]: r["df"] for r in dfs.collect()}  # of the pack's terms
        whole = Pack(rows, found, size[0] or 0, size[1] or 1)
        if not whole.rows:
            continue
        pack = spark.sparkContext.broadcast(whole)
        tried = _top(highest(index, pack, TRIED), "item", [F.col("bound").desc(), "doc_id", "mark"], TRIED)
        least = _top(scored(docs, tried, pack), "item", [F.col("score").desc()], k).groupBy("item").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
        floors = np.zeros(len(whole.rows))
        for r in least.collect():  # a row for each item of the pack
            if r["n"] >= k:
                floors[r["item"]] = r["floor"]
        exact = scored(docs, reaching(index, pack, spark.sparkContext.broadcast(floors)), pack)
        best = _top(exact, "item", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
        names = spark.createDataFrame(list(enumerate(whole.item_ids)), "item bigint, item_id bigint")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        best = materialize(best, "ranked-best") if packs > 1 else best
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out
