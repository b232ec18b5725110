"""Packing token sequences by cutting-stock column generation.

Documents become pieces: whole sequences of ``CAPACITY`` tokens and a rest.  A histogram of piece
lengths, in classes of ``UNIT`` tokens, is all that the driver sees; its size doesn't depend on the data.
The linear program over packing patterns is solved by column generation: a knapsack by dynamic
programming prices new patterns against the simplex multipliers.  Rounded down, patterns say how many
pieces of each class go into how many sequences; pieces, ranked inside their class, find their sequence
by rank.  What rounding leaves over (at most a pattern's pieces for each class) is laid end to end and cut
at the capacity.

Ranks inside a class come from counts by (class, shard) and a numbering inside each pair, so a length
that a third of all documents share is spread over all shards.

Defined results: a null text is an empty one, whose only token is the end mark; rows with equal ids are
packed one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import steps
from .scratch import materialize

CAPACITY = 4096
UNIT = 16
END = 2
#: Words, and as many from before, whose ids a worker remembers at most; longer ones aren't remembered.
REMEMBERED, LONGEST = 300_000, 64
#: Rows of (class, shard) counts that are broadcast at most.
FEW = 200_000


class Recent:
    """Values by word: of the last words asked for, at least ``REMEMBERED``, twice that at most."""

    def __init__(self) -> None:
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def missing(self, words: set[bytes]) -> set[bytes]:
        """The words that aren't known; the others are in ``now``."""
        new = words - self.now.keys()
        back = new & self.before.keys()
        self.now.update((w, self.before[w]) for w in back)
        return new - back

    def trim(self, new: Iterable[bytes]) -> None:
        """To be called when ``new`` words have been used."""
        for w in new:
            if len(w) > LONGEST:
                del self.now[w]
        if len(self.now) >= REMEMBERED:
            self.before, self.now = self.now, {}


class WordIds:
    """The ids of a text, as little-endian unsigned 32-bit values, put together from those of its words.

    The tokenizer drops white space and never joins across it, so words can be encoded one by one and
    remembered.  ASCII letters are lowered, and a last full stop or comma after a letter or digit is set apart,
    before that: the tokenizer does the same, and fewer different words are left.  Texts with combining marks
    aren't lowered: a lowered letter can compose with a mark that its capital doesn't compose with.

    New words of letters are encoded as one text; each ends in a token that ends words.

    With ``added``, the tokenizer's added tokens in a text have their own ids, as is the library's default.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # added tokens never get there: a lowered word may look like one
        marks = {m.content.encode(): k for k, m in self.tokenizer.get_added_tokens_decoder().items()} if added else {}
        self.marks = re.compile(b"(" + b"|".join(map(re.escape, marks)) + b")") if marks else None
        # no word begins with a space
        self.added = {b" " + m: np.array([k], "<u4").tobytes() for m, k in marks.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        self.words, self.cores = Recent(), Recent()

    def _split(self, text: bytes) -> list[bytes]:
        if self.marks and self.marks.search(text):
            parts = self.marks.split(text)
            return [w for k, part in enumerate(parts) for w in ([b" " + part] if k % 2 else self._lowered(part).split())]
        return self._lowered(text).split()

    @staticmethod
    def _lowered(text: bytes) -> bytes:
        """With ASCII letters in lower case, unless a lead byte of U+0300 to U+037F is there."""
        return text if b"\xcc" in text or b"\xcd" in text else text.lower()

    def _learn(self, new: set[bytes]) -> None:
        """Makes new words known."""
        parts: dict[bytes, tuple[bytes, ...]] = {}
        for word in new:
            if word in self.added:
                self.words.now[word] = self.added[word]
                continue
            if word.endswith((b".", b",")) and word[-2:-1].isalnum():
                parts[word] = (word[:-1], word[-1:])
            else:
                parts[word] = (word,)
        cores = self.cores.missing({c for both in parts.values() for c in both})
        plain, others = [], []
        for core in cores:
            word = core.decode()
            (plain if word.isalpha() else others).append((core, word))
        ids = np.array(self.tokenizer.encode(" ".join([w for _, w in plain]), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(plain):
            raw, at = ids.tobytes(), 0
            for (core, _), end in zip(plain, (4 * ends).tolist()):
                self.cores.now[core] = raw[at:end]
                at = end
        else:  # a letter became a letter and a mark when it was lowered
            others += plain
        found = self.tokenizer.encode_batch_fast([w for _, w in others], add_special_tokens=False)
        self.cores.now.update((c, np.array(e.ids, "<u4").tobytes()) for (c, _), e in zip(others, found))
        of = self.cores.now
        self.words.now.update((w, of[both[0]] + of[both[1]] if len(both) > 1 else of[both[0]]) for w, both in parts.items())
        self.cores.trim(cores)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        new = self.words.missing(set(chain.from_iterable(split)))
        if new:
            self._learn(new)
        ids_of = self.words.now.__getitem__
        out = [b"".join(map(ids_of, words)) for words in split]
        self.words.trim(new)
        return out


_WORKER: dict[tuple[str, bool], WordIds] = {}


def _ids(path: str, added: bool) -> WordIds:
    if (path, added) not in _WORKER:
        _WORKER[path, added] = WordIds(path, added)
    return _WORKER[path, added]


_PIECE = "doc_id bigint, text_key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, tokenizer: str, added: bool = False) -> DataFrame:
    """A row for each piece of at most CAPACITY tokens of each document."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer, added)
        for batch in batches:
            for a, b in steps(batch.column("text")):
                part = batch.slice(a, b - a)
                ids, keys = part.column("doc_id").to_pylist(), part.column("text_key").to_pylist()
                rows = []
                for doc, key, body in zip(ids, keys, encode(part.column("text").cast(pa.binary()).to_pylist())):
                    body += end
                    n = len(body) // 4
                    for s in range(0, n, CAPACITY):
                        cut = body[4 * s : 4 * (s + CAPACITY)]
                        rows.append((doc, key, s, len(cut) // 4, zlib.crc32(cut), n))
                yield _arrow(rows, ["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens"])

    return _keyed(docs).mapInArrow(run, _PIECE)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _arrow(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the dearest pattern that fits, and how often it takes each size."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = upto[c]
        value[c], last[c] = value[c - 1], -1
        if k:
            tried = value[c - sizes[:k]] + prices[:k]
            best = int(tried.argmax())
            if tried[best] > value[c] + 1e-12:
                value[c], last[c] = tried[best], best
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return float(value[capacity]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination, a row at a time: a driver's threads of linear algebra can wait for each other for good."""
    m = len(matrix)
    both = np.concatenate([matrix.astype(float), np.eye(m)], axis=1)
    for k in range(m):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        if pivot != k:
            both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        both -= others[:, None] * both[k]
    return both[:, m:]


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) of the rounded solution; sizes ascend.  Patterns never ask for more than the demand.

    Column generation ends when no pattern is worth more than a sequence, or when the solution is within
    ``gap`` of a lower bound: the volume, or what the dearest pattern's worth gives.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    volume = float(sizes @ demand) / capacity
    turn = 0
    while True:
        prices = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = _best_pattern(sizes, prices, capacity)
        least = max(x.sum() / worth, volume) if worth > 0 else volume
        if worth <= 1 + 1e-7 or x.sum() <= (1 + gap) * least:
            break
        used = np.flatnonzero(pattern)
        step = (inverse[:, used] * pattern[used]).sum(axis=1)
        rising = step > 1e-9
        ratios = np.full(m, np.inf)
        ratios[rising] = x[rising] / step[rising]
        out = int(ratios.argmin())
        amount = max(0.0, ratios[out])
        x = np.maximum(x - amount * step, 0)
        x[out] = amount
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        turn += 1
        if turn % 200 == 0:
            inverse = _inverse(basis)
            x = np.maximum(inverse @ demand, 0)
    left = demand.astype(np.int64).copy()
    chosen = []
    for k in np.argsort(-x):
        pattern = basis[:, k].astype(np.int64)
        used = pattern > 0
        times = min(int(x[k] + 1e-6), int((left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            left -= times * pattern
            chosen.append((times, pattern))
    return chosen


def pack(docs: DataFrame, tokenizer: str, added: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    ``added``: the tokenizer's added tokens in a text have their own ids, and aren't read as plain text.
    """
    spark = docs.sparkSession
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = materialize(pieces(docs, tokenizer, added), "pieces")
    classed = made.withColumn("cls", F.ceil(F.col("length") / UNIT).cast("int")).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("int")
    )
    counts = materialize(classed.groupBy("cls", "shard").agg(F.count("*").alias("n")), "piece-counts")
    histogram = sorted((r["cls"], r["n"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect())
    sizes, demand = np.array([c for c, _ in histogram], int), np.array([n for _, n in histogram], float)

    slots, base, taken = [], 0, dict.fromkeys(sizes.tolist(), 0)
    for times, pattern in patterns(sizes, demand, CAPACITY // UNIT):
        for i in np.flatnonzero(pattern):
            c, each = int(sizes[i]), int(pattern[i])
            slots.append((c, taken[c], taken[c] + times * each, base, each))
            taken[c] += times * each
        base += times
    slot = spark.createDataFrame(slots, "cls int, low bigint, high bigint, base bigint, each bigint")

    earlier = Window.partitionBy("cls").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cls", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("cls", "shard").orderBy("doc_id", "start", "text_key")
    small = len(histogram) * shards <= FEW
    ranked = (
        classed.withColumn("k", F.row_number().over(inside))
        .join(F.broadcast(offsets) if small else offsets, ["cls", "shard"])
        .withColumn("rank", F.col("before") + F.col("k") - 1)
        .select("doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens", F.col("cls").alias("c"), "rank")
    )
    fits = (F.col("c") == F.col("cls")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = materialize(ranked.join(F.broadcast(slot), fits, "left"), "placed-pieces")

    whole = placed.filter(F.col("base").isNotNull()).withColumn("sequence_id", F.expr("base + (rank - low) div each"))
    order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "text_key", "rank")
    at = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    packed = whole.withColumn("offset", at).select(columns)

    # the rest, bounded by the number of classes and not by the data, is laid end to end
    line = Window.orderBy(F.col("c").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = placed.filter(F.col("base").isNull()).withColumn("from", F.coalesce(F.sum("length").over(line), F.lit(0)))
    first, final = F.expr(f"`from` div {CAPACITY}"), F.expr(f"(`from` + length - 1) div {CAPACITY}")
    cut = (
        rest.withColumn("s", F.explode(F.sequence(first, final)))
        .withColumn("a", F.greatest(F.col("from"), F.col("s") * CAPACITY))
        .withColumn("b", F.least(F.col("from") + F.col("length"), (F.col("s") + 1) * CAPACITY))
        .select(
            "doc_id", "text_key", (F.col("start") + F.col("a") - F.col("from")).alias("start"), (F.col("b") - F.col("a")).alias("length"),
            "ids_crc32", "doc_tokens", (F.lit(base) + F.col("s")).alias("sequence_id"), (F.col("a") - F.col("s") * CAPACITY).alias("offset"),
            (F.col("b") - F.col("a") < F.col("length")).alias("parted"),
        )
    )
    cut = materialize(cut, "rest-pieces")
    parted = cut.filter("parted").groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", "length", "doc_tokens", "sequence_id", "offset")).alias("cuts")
    )
    return packed.unionByName(cut.filter("NOT parted").select(columns)).unionByName(_recut(docs, parted, tokenizer, added))


def _recut(docs: DataFrame, parted: DataFrame, tokenizer: str, added: bool) -> DataFrame:
    """Checksums of the parts of a cut piece; its document, one for each cut, is encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer, added)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            bodies = encode(batch.column("text").cast(pa.binary()).to_pylist())
            for doc, cuts, body in zip(batch.column("doc_id").to_pylist(), batch.column("cuts").to_pylist(), bodies):
                body += end
                for c in cuts:
                    crc = zlib.crc32(body[4 * c["start"] : 4 * (c["start"] + c["length"])])
                    rows.append((doc, c["start"], c["length"], crc, c["doc_tokens"], c["sequence_id"], c["offset"]))
            yield _arrow(rows, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    keyed = _keyed(docs)
    named = parted.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "cuts")
    found = keyed.join(F.broadcast(named), keyed["doc_id"].eqNullSafe(named["d"]) & (keyed["text_key"] == named["t"]))
    once = found.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.first("cuts").alias("cuts"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return once.select("doc_id", "cuts", "text").mapInArrow(run, schema)
