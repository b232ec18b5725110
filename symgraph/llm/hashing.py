"""Words and rolling window hashes of a whole Arrow column of texts at once, in numpy.

Hashes are polynomials modulo 2 ** 64 with odd bases over mixed values, so that any span's hash
comes from two prefix sums.  They don't depend on the place of a text in its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_BYTE_BASE, _WORD_BASE = U64(0x9E3779B97F4A7C15 | 1), U64(0xC2B2AE3D27D4EB4F | 1)
#: Bytes of text per numpy step; a longer text is a step of its own.
STEP_BYTES = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all (the splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _powers(base: U64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i below n at least."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, STEP_BYTES + 1)
        up = np.full(size, base, U64)
        up[0] = 1
        down = np.full(size, pow(int(base), -1, 1 << 64), U64)
        down[0] = 1
        have = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
        if size <= 4 * STEP_BYTES:  # of one very long text they aren't kept
            _POWERS[int(base)] = have
    return have


def _span_hash(values: np.ndarray, base: U64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


class Words:
    """The words of consecutive texts: where each begins and ends in ``data``, its text and its hash."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if len(offsets) == 0:
            offsets = np.zeros(1, np.int64)
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        n = len(self.data)
        solid = ~_IS_SPACE[self.data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        first[inner] = solid[inner]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        last[inner - 1] = solid[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.text_of = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.hashes = _span_hash(_BYTE_VALUE[self.data], _BYTE_BASE, self.starts, self.ends)
        counts = np.bincount(self.text_of, minlength=len(texts)) if len(self.starts) else np.zeros(len(texts), np.int64)
        #: words of text t are first[t] to first[t + 1]
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def place(self) -> np.ndarray:
        """Each word's number in its text."""
        return np.arange(len(self.starts)) - self.first[self.text_of]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the windows of ``length`` words that lie within one text."""
        n = len(self.starts)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.arange(n - length + 1)
        at = at[self.text_of[at] == self.text_of[at + length - 1]]
        return at, _span_hash(self.hashes, _WORD_BASE, at, at + length)


def steps(texts: pa.Array, most: int = STEP_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text, and ``rows`` rows at most; texts stay whole."""
    sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        to = to if rows is None else min(to, at + rows)
        yield at, to
        at = to
