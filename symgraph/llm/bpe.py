"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding.  The tokens of each prefix of a pre-token are unique, and a sequence is the encoding of its
bytes exactly if each pair of neighbours is the encoding of the pair's bytes.  So a left-to-right machine
needs to know, for each place where a token of the final encoding may still begin (a live place: what
follows it so far is the beginning of some token), the trie node reached since and the last token before it.
A state is the list of these pairs; there are finitely many, as tokens are bounded.  A transition says which
token ends the encoding of the prefix read so far.  These last tokens chain every live place back to what
has been emitted; where the chains of all live places meet, tokens are final and are emitted, so what is
held back is bounded by how far chains run apart.  States and transitions are made when a text first needs
them and kept.

Decoding.  Ids become bytes, and a state machine over UTF-8 (how many continuation bytes are due, and in
which range the next must be) says how far the bytes so far are whole characters, so text can be passed on
while ids still come.  Its steps for (state, token) are kept as well.  A token of whole characters leaves
the state between characters as it is, so of a long run of ids only others are walked.

Defined results: a null text is an empty one and has no ids; ids of an empty text decode to nothing; bytes
that can't be UTF-8 become U+FFFD in decoded text, and stay as they are in decoded bytes.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import steps


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Bytes between two looks for tokens that are final.
LOOK = 64
#: Pairs of numbers are kept as one, the second below 1 << SHIFT.
SHIFT = 20
MASK = (1 << SHIFT) - 1


class Transducer:
    """Encodes pre-tokens; tables grow with what has been read, up to ``most`` states."""

    def __init__(self, ranks: dict[bytes, int], most: int = 250_000):
        if max(ranks.values(), default=0) >= MASK:
            raise ValueError(f"tokens must be below {MASK}")
        self.ranks, self.most = ranks, most
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        # trie nodes are numbers; token_at gives the token that ends in a node
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        for word, token in ranks.items():
            node = 0
            for b in word:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][b]
            self.token_at[node] = token
        self.pair: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        self.pair.clear()
        # a state: the live places, the longest suffix first, each as node << SHIFT | last token + 1
        self.number: dict[tuple[int, ...], int] = {(0,): 0}
        self.state: list[tuple[int, ...]] = [(0,)]
        #: 256 * state + byte: the next state << SHIFT | token
        self.next: dict[int, int] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, together, are encoded as these two."""
        if left < 0:
            return True
        key = left << SHIFT | right
        known = self.pair.get(key)
        if known is None:
            known = self.pair[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens.

        Merges are undone from the last to the first: of the parts that meet at the border, the one that was
        made later is taken back to its half at the border.  A merge across the border would have come first
        if its rank is less than that of the merge undone or, as the leftmost goes first, equal to it on the right.
        """
        if not (self._halves(left) and self._halves(right)):
            return False
        before = 1 << 60
        while True:
            if self.ranks.get(self.bytes_of[left] + self.bytes_of[right], before) < before:
                return False
            first, second = self.halves[left], self.halves[right]
            if len(first) == 1 and len(second) == 1:
                return True
            if len(second) == 1 or (len(first) > 1 and left > right):
                before, left = left, first[1]
            else:
                before, right = right + 1, second[0]

    def _halves(self, token: int) -> tuple[int, ...]:
        """The two tokens that a token was merged from; of a byte, itself; of one that merges never reach, none."""
        known = self.halves.get(token)
        if known is None:
            word = self.bytes_of[token]
            parts = self._merge(word, 2)
            known = tuple(parts) if len(word) == 1 or (len(parts) == 2 and self._merge(word) == [token]) else ()
            self.halves[token] = known
            for part in known:
                if part != token:
                    self._halves(part)
        return known

    def _merge(self, word: bytes, down_to: int = 1) -> list[int]:
        """The encoding by its definition: the pair of the least rank is merged, the leftmost first."""
        rank_of, none = self.ranks.get, 1 << 60
        cuts = list(range(len(word) + 1))
        ranks = [rank_of(word[i : i + 2], none) for i in range(len(word) - 1)]
        while len(ranks) >= down_to:
            least = min(ranks)
            if least == none:
                break
            at = ranks.index(least)
            del cuts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(word[cuts[at] : cuts[at + 2]], none)
            if at:
                ranks[at - 1] = rank_of(word[cuts[at - 1] : cuts[at + 1]], none)
        return [self.ranks[word[i:j]] for i, j in zip(cuts, cuts[1:])]

    def _step(self, key: int) -> int:
        state, byte = divmod(key, 256)
        live, ended = [], -1
        for place in self.state[state]:
            child = self.children[place >> SHIFT].get(byte)
            if child is None:
                continue
            last = place & MASK
            if self.children[child]:
                live.append(child << SHIFT | last)
            token = self.token_at[child]
            if token >= 0 and ended < 0 and self.follows(last - 1, token):
                ended = token
        if ended < 0:
            raise ValueError("a byte is missing from the vocabulary")
        live.append(ended + 1)
        made = tuple(live)
        at = self.number.get(made)
        if at is None:
            at = self.number[made] = len(self.state)
            self.state.append(made)
        found = self.next[key] = at << SHIFT | ended
        return found

    def _chain(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` bytes."""
        out = []
        while end:
            token = lasts[end - 1]
            out.append(token)
            end -= self.length[token]
        out.reverse()
        return out

    def _final(self, state: int, lasts: list[int]) -> int:
        """Up to where tokens are final: the last place on the chains of all live places."""
        places = {len(lasts) - self.depth[place >> SHIFT] for place in self.state[state]}
        while len(places) > 1:
            top = max(places)
            places.remove(top)
            places.add(top - self.length[lasts[top - 1]])
        return places.pop()

    def stream(self, word: bytes) -> Iterator[list[int]]:
        """The ids, as soon as they are final."""
        table, state, lasts = self.next, 0, []
        for at in range(0, len(word), LOOK):
            for b in word[at : at + LOOK]:
                key = state << 8 | b
                step = table.get(key) or self._step(key)  # never 0, as no step leads back to the start
                state = step >> SHIFT
                lasts.append(step & MASK)
            if at + LOOK < len(word):
                final = self._final(state, lasts)
                yield self._chain(lasts, final)
                del lasts[:final]
        yield self._chain(lasts, len(lasts))

    def encode(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self.state) > self.most:
            self._reset()
        parts = list(self.stream(word))
        return parts[0] if len(parts) == 1 else [t for part in parts for t in part]


#: By first byte: continuation bytes due and the range of the first of them.  Fixed values of UTF-8.
_LEAD = (
    {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
    | {b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)}
    | {b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}
    | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}
)


class Decoder:
    """Bytes and text of a stream of ids."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.states: dict[tuple[int, int, int], int] = {(0, 0, 0): 0}
        self.listed = [(0, 0, 0)]
        self.known: dict[tuple[int, int], tuple[int, int, bool]] = {}
        self.flat: np.ndarray | None = None

    def _walk(self, state: int, token: int) -> tuple[int, int, bool]:
        """The state after a token, how many of its last bytes are an open character, and whether all fits UTF-8."""
        due, low, high = self.listed[state]
        tail, fits = 0, True
        for b in self.bytes_of[token]:
            if due:
                if low <= b <= high:
                    due, low, high, tail = due - 1, 0x80, 0xBF, tail + 1
                    if not due:
                        low = high = tail = 0
                    continue
                fits, due, low, high, tail = False, 0, 0, 0, 0
            if b >= 0x80:
                if b in _LEAD:
                    (due, low, high), tail = _LEAD[b], 1
                else:
                    fits = False
        key = (due, low, high)
        if key not in self.states:
            self.states[key] = len(self.listed)
            self.listed.append(key)
        return self.states[key], tail, fits

    def _tables(self) -> None:
        """Bytes of all tokens in a row, where each begins, and which are whole characters."""
        size = max(self.bytes_of, default=-1) + 1
        words = [self.bytes_of.get(k, b"") for k in range(size)]
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        steps_ = [self._walk(0, k) if w else (0, 0, True) for k, w in enumerate(words)]
        self.closed = np.array([state == 0 and fits for state, _, fits in steps_], bool)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lists of ids, put one after another, that end at ``ends``: all bytes, where each list's end, and whether
        these are whole characters from end to end."""
        if self.flat is None:
            self._tables()
        sizes = self.sizes[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        data = self.flat[np.repeat(self.starts[ids] - upto[:-1], sizes) + np.arange(upto[-1])]
        good, begins = np.ones(len(ends), bool), np.concatenate([[0], ends[:-1]]).astype(np.int64)
        others = np.flatnonzero(~self.closed[ids])
        owners, done = np.searchsorted(ends, others, "right"), -1
        for k, owner in zip(others.tolist(), owners.tolist()):
            if k < done or not good[owner]:
                continue
            state, done = 0, max(k, int(begins[owner]))
            while done < ends[owner]:
                key = (state, int(ids[done]))
                step = self.known.get(key) or self.known.setdefault(key, self._walk(*key))
                state, done = step[0], done + 1
                good[owner] &= step[2]
                if not state:
                    break
            good[owner] &= state == 0
        return data, upto[ends], good

    def whole(self, ids: Iterable[int]) -> tuple[bytes, bool]:
        """The bytes of all ids, and whether they are whole characters from end to end."""
        ids = np.array(list(ids), np.int64)
        data, _, good = self.decode(ids, np.array([len(ids)]))
        return data.tobytes(), bool(good[0])

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its characters are whole; what is open at the end becomes U+FFFD."""
        state, held, open_ = 0, b"", 0
        for token in ids:
            step = self.known.get((state, token)) or self.known.setdefault((state, token), self._walk(state, token))
            piece = self.bytes_of[token]
            inside = step[1] if step[1] < len(piece) or not step[0] else open_ + len(piece)
            state, held = step[0], held + piece
            open_ = inside if state else 0
            ready, held = (held[: len(held) - open_], held[len(held) - open_ :]) if open_ else (held, b"")
            if ready:
                yield ready.decode("utf-8", "replace")
        if held:
            yield held.decode("utf-8", "replace")


class _Known(dict):
    """Ids of pre-tokens as bytes, worked out when they are first asked for.

    What was asked for lately is found again in ``before``, the dictionary that this one replaced.
    """

    def __init__(self, encode, before: dict[str, bytes]):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = np.array(self.encode(piece.encode("utf-8")), "<i4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """A worker's transducer, decoder and pre-token pattern."""

    def __init__(self, path: str, pattern: str, remembered: int = 200_000):
        import regex

        ranks = load_ranks(path)
        self.transducer, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.decoder = Decoder(self.transducer.bytes_of)
        self.known, self.remembered = _Known(self.transducer.encode, {}), remembered

    def encoded(self, text: str) -> bytes:
        """The ids as little-endian 32-bit values."""
        if len(self.known) > self.remembered:
            self.known.before = {}
            self.known = _Known(self.transducer.encode, dict(self.known))
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), "<i4").tolist()


_WORKER: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = Codec(path, pattern)
        # the tables are large, free of cycles and only grow: the collector needn't look through them
        gc.freeze()
        gc.set_threshold(1_000_000, 50, 1000)
    return _WORKER[path, pattern]


_DECODERS: dict[str, Decoder] = {}


def _decoder(path: str) -> Decoder:
    if path not in _DECODERS:
        _DECODERS[path] = Decoder({v: k for k, v in load_ranks(path).items()})
    return _DECODERS[path]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids, an array of int, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for a, b in steps(batch.column("text")):
                part = batch.slice(a, b - a)
                ids = [codec.encoded(t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.record_batch([part.column("doc_id"), lists], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def _portions(batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows with about ``most`` ids at a time; a document stays whole."""
    ends = np.cumsum(np.asarray(batch.column("ids").value_lengths().fill_null(0), np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids, their bytes ``data`` and whether these are whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(ranks)
        for batch in batches:
            for part in _portions(batch):
                ids = part.column("ids")
                flat, first = np.asarray(ids.flatten()).astype(np.int64), np.asarray(ids.value_lengths().fill_null(0), np.int64)
                data, ends, whole = decoder.decode(flat, np.cumsum(first))
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
                made = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(data.tobytes())])
                yield pa.record_batch([part.column("doc_id"), ids, made, pa.array(whole)], names=["doc_id", "ids", "data", "whole"])

    return encoded.mapInArrow(run, "doc_id bigint, ids array<int>, data binary, whole boolean")
