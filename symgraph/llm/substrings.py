"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window that covers it
also starts in a document with a smaller id.

Word places whose remainder by ``PERIOD`` is in ``COVER`` carry an anchor, a hash of ``ANCHOR`` words.
COVER is a perfect difference cover: for any two places there is a shift below PERIOD that brings both
on cover places.  As ANCHOR + PERIOD - 1 = WINDOW, two equal windows share an aligned anchor.  So:

1. anchors are matched; those in two documents or more are shared;
2. only windows that hold a shared anchor are hashed, which extends the matches to full windows, and
   the least document of each window is found;
3. each document drops what its smaller-id windows cover.

Documents are dealt to buckets of bounded size by a hash of id, text and file split, so that neither null
or repeated ids nor copies meet in one.  Inside a bucket anchors and
windows are made distinct before they are sent, and answers go to buckets, not to documents: a
passage that a third of all documents share costs a row per bucket.  The three passes read the same
exchange of the texts.

Windows are told apart by 64-bit hashes; only windows with shared anchors meet each other.

Defined results: a null text has no words and stays null; rows with a null doc_id, or with equal
ids, don't remove anything from each other; texts shorter than a window stay as they are; further
columns are passed through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import U64, Words, steps

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Text in a bucket, which is held in a task's memory, and buckets for each shuffle partition at least.
BUCKET_BYTES, BUCKETS = 24 << 20, 4

_BLOBS = pa.schema([("bucket", pa.int64()), ("pid", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary())])
_REPLY = pa.schema([("pid", pa.int64()), ("hashes", pa.binary())])


def _parts(table: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, Words]]:
    """Row numbers, ids and words of a table's documents that can match, in steps of bounded size."""
    for batch in table.to_batches():
        valid = batch.column("doc_id").is_valid()
        ids = np.asarray(batch.column("doc_id").fill_null(0), dtype=np.int64)
        texts = batch.column("__text")
        for a, b in steps(texts):
            part = texts.slice(a, b - a).fill_null("")
            yield batch.slice(a, b - a), np.where(np.asarray(valid, dtype=bool)[a:b], ids[a:b], -1), np.asarray(valid, dtype=bool)[a:b], Words(part)


def _anchors(words: Words, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    on_cover = np.zeros(PERIOD, bool)
    on_cover[list(COVER)] = True
    at, hashes = words.windows(ANCHOR)
    if not len(at):
        return at, hashes
    take = on_cover[words.place()[at] % PERIOD] & valid[words.text_of[at]]
    return at[take], hashes[take]


def _least(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the least owner of each, and whether it has another."""
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(new)
    most = owners[np.append(first[1:], len(hashes)) - 1] if len(first) else owners
    return hashes[first], owners[first], most != owners[first]


def _sent(pid: int, hashes: np.ndarray, owners: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows for the matchers, which divide the range of the (ordered) hashes."""
    of = ((hashes >> U64(32)) * U64(buckets)) >> U64(32)
    cuts = np.flatnonzero(np.diff(of, prepend=of[:1] + U64(1), append=of[-1:] + U64(1)))
    for a, b in zip(cuts, cuts[1:]):
        yield int(of[a]), pid, hashes[a:b].tobytes(), owners[a:b].tobytes()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _read(column: pa.ChunkedArray, dtype: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype) for x in column]


def _joined(parts: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` without repeated windows in ``text``, and with __n_words and __n_removed.

    A kept word keeps the white space after it; texts that lose nothing are unchanged.
    """
    spark, names = docs.sparkSession, docs.columns
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(BUCKETS * partitions, -(-total // bucket_bytes))
    matchers = max(partitions, n // BUCKETS)
    others = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in names if c != "text"])
    held = docs.select(
        F.pmod(F.xxhash64("doc_id", "text", F.input_file_name(), F.input_file_block_start()), F.lit(n)).alias("pid"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").alias("__text"),
        others.alias("__row"),
    ).repartition(max(partitions, n // BUCKETS), "pid")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            pids = np.asarray(batch.column("pid"), dtype=np.int64)
            at = 0
            for rows, ids, valid, words in _parts(pa.Table.from_batches([batch])):
                own = pids[at : at + rows.num_rows]
                at += rows.num_rows
                where, hashes = _anchors(words, valid)
                texts = words.text_of[where]
                for pid in np.unique(own):
                    mine = own[texts] == pid
                    # the same anchor again in a text doesn't count; a step makes pairs distinct
                    found.setdefault(int(pid), []).append((hashes[mine], ids[texts[mine]]))
        for pid, parts in found.items():
            hashes, _, twice = _least(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            if len(hashes):
                yield _batch(list(_sent(pid, hashes, twice.astype(np.uint8), matchers)), _BLOBS)

    def shared(table: pa.Table) -> pa.Table:
        """Anchors in two buckets, or twice in one: told to each bucket that has them."""
        parts = _read(table.column("hashes"), U64)
        hashes, twice = _joined(parts, U64), _joined(_read(table.column("owners"), np.uint8), np.uint8)
        pids = np.repeat(np.asarray(table.column("pid"), dtype=np.int64), [len(p) for p in parts])
        order = np.argsort(hashes, kind="stable")
        hashes, twice, pids = hashes[order], twice[order], pids[order]
        same = hashes[1:] == hashes[:-1]
        keep = twice.astype(bool)
        keep[1:] |= same
        keep[:-1] |= same
        return _told(pids[keep], hashes[keep])

    def _told(pids: np.ndarray, hashes: np.ndarray) -> pa.Table:
        order = np.argsort(pids, kind="stable")
        pids, hashes = pids[order], hashes[order]
        names_, first = np.unique(pids, return_index=True)
        ends = np.append(first[1:], len(pids))
        rows = [(int(p), hashes[a:b].tobytes()) for p, a, b in zip(names_, first, ends)]
        return pa.Table.from_batches([_batch(rows, _REPLY)] if rows else [], schema=_REPLY)

    def extended(key: tuple, texts: pa.Table, reply: pa.Table) -> pa.Table:
        """Windows around shared anchors, each with its least document in this bucket."""
        hot = np.sort(_joined(_read(reply.column("hashes"), U64), U64))
        found, owners = [], []
        if len(hot):
            for _, ids, valid, words in _parts(texts):
                where, hashes = _anchors(words, valid)
                count = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(count, where[_in(hashes, hot)] + 1, 1)
                count = np.cumsum(count)
                at, hashes = words.windows(WINDOW)
                take = count[at + WINDOW - ANCHOR + 1] > count[at]
                found.append(hashes[take])
                owners.append(ids[words.text_of[at[take]]])
        rows = []
        if found:
            hashes, least, _ = _least(np.concatenate(found), np.concatenate(owners))
            rows = list(_sent(key[0].as_py(), hashes, least, matchers))
        return pa.Table.from_batches([_batch(rows, _BLOBS)] if rows else [], schema=_BLOBS)

    def owned(table: pa.Table) -> pa.Table:
        """Windows whose least document is in another bucket: told to the bucket."""
        parts = _read(table.column("hashes"), U64)
        hashes, owners = _joined(parts, U64), _joined(_read(table.column("owners"), np.int64), np.int64)
        pids = np.repeat(np.asarray(table.column("pid"), dtype=np.int64), [len(p) for p in parts])
        order = np.lexsort((owners, hashes))
        hashes, owners, pids = hashes[order], owners[order], pids[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        least = owners[np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))] if len(hashes) else owners
        other = owners > least
        return _told(pids[other], hashes[other])

    row_type = held.schema["__row"].dataType
    schema = T.StructType(
        [
            T.StructField("__row", row_type),
            T.StructField("text", T.StringType()),
            T.StructField("__n_words", T.LongType()),
            T.StructField("__n_removed", T.LongType()),
        ]
    )

    def cut(key: tuple, texts: pa.Table, reply: pa.Table) -> pa.Table:
        elsewhere = np.sort(_joined(_read(reply.column("hashes"), U64), U64))
        parts = list(_parts(texts))
        found = [w.windows(WINDOW) for _, _, _, w in parts]
        hashes = _joined([h[v[w.text_of[at]]] for (at, h), (_, _, v, w) in zip(found, parts)], U64)
        owners = _joined([i[w.text_of[at]][v[w.text_of[at]]] for (at, _), (_, i, v, w) in zip(found, parts)], np.int64)
        seen, least, several = _least(hashes, owners)
        seen, least = seen[several], least[several]
        out = []
        for (at, own), (rows, ids, valid, words) in zip(found, parts):
            doc = ids[words.text_of[at]]
            gone = _in(own, elsewhere)
            if len(seen):
                k = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
                gone |= (seen[k] == own) & (doc > least[k])
            gone &= valid[words.text_of[at]] if len(at) else gone
            edge = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(edge, at[gone], 1)
            np.add.at(edge, at[gone] + WINDOW, -1)
            drop = np.cumsum(edge[:-1]) > 0
            n_words = np.diff(words.first)
            n_removed = np.zeros(len(n_words), np.int64)
            np.add.at(n_removed, words.text_of[drop], 1)
            column = rows.column("__text")
            if drop.any():
                values, raw = column.to_pylist(), words.data
                # a word's span reaches to the next word of its text
                upto = np.append(words.starts[1:], len(raw))
                last = words.first[1:][np.diff(words.first) > 0] - 1
                upto[last] = words.offsets[words.text_of[last] + 1]
                for t in np.flatnonzero(n_removed):
                    a, b = words.first[t], words.first[t + 1]
                    flips = np.flatnonzero(np.diff(np.concatenate([[True], drop[a:b], [True]]).astype(np.int8)))
                    spans = [raw[words.starts[a + x] : upto[a + y - 1]].tobytes() for x, y in zip(flips[::2], flips[1::2])]
                    values[t] = b"".join(spans).decode("utf-8").rstrip(" \t\n\x0b\x0c\r")
                column = pa.array(values, pa.string())
            out.append(pa.record_batch([rows.column("__row"), column.cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["__row", "text", "__n_words", "__n_removed"]))
        if not out:
            return pa.table([texts.column("__row"), texts.column("__text").cast(pa.string()), pa.nulls(0, pa.int64()), pa.nulls(0, pa.int64())], names=["__row", "text", "__n_words", "__n_removed"])
        return pa.Table.from_batches(out)

    blobs = "bucket bigint, pid bigint, hashes binary, owners binary"
    reply = "pid bigint, hashes binary"
    hot = held.mapInArrow(anchors, blobs).groupBy("bucket").applyInArrow(shared, reply)
    windows = held.groupBy("pid").cogroup(hot.groupBy("pid")).applyInArrow(extended, blobs)
    away = windows.groupBy("bucket").applyInArrow(owned, reply)
    done = held.groupBy("pid").cogroup(away.groupBy("pid")).applyInArrow(cut, schema)
    return done.select(
        *[F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in names], "__n_words", "__n_removed"
    )
