"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks in page order: the text between block-level tags, with the tags that are
open around it and their class, id and role words.  A bidirectional LSTM in numpy reads, for each block, a
hashed vector of its tag path and one of its words, and labels it main text or not in the light of the
whole page.  It is trained here, on a bounded sample of pages, whose labels come from the names of the
elements around a block; names, or all but their kind, are hidden from it at random in training, so that it
learns from words, shapes and neighbours too.

Defined results: a null or empty html has no text; unclosed and stray tags are allowed; scripts, styles,
forms and comments never are text, nor is what a head may hold; texts of any length are read whole; rows with
equal ids are read one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that are trained on at most.
TRAIN_PAGES = 300
#: Characters of a page that is learnt from, at most.
TRAIN_CHARS = 1 << 20
PATH_DIMS, WORD_DIMS, HIDDEN = 64, 32, 16
INPUTS = PATH_DIMS + WORD_DIMS + 6
TRAIN_BLOCKS, PASSES, SEED = 96, 12, 7

# Names of HTML elements by their role.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("script style textarea title iframe".split())
_SILENT = frozenset("noscript template select svg math object button option".split())
_CELLS = frozenset("tbody td tfoot th thead tr".split())
_ITEMS = frozenset("dd dt li".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCKS - {"html", "body"}
#: Words around a block that tell what it is, for the labels of the training sample.
_MAIN = frozenset("article main content post entry story".split())
_OTHER = frozenset(
    "nav header footer aside form dialog ad ads advert advertisement banner sidebar menu comment comments reply cookie consent notice "
    "promo sponsored share social related breadcrumb newsletter subscribe login popup widget toolbar pagination".split()
)
#: Quotes count in a tag only after an equals sign; possessive, so that a tag without an end costs one pass.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _ends(silent: str, tag: str, closing: bool, inner: list[str], open_: list[tuple[str, tuple[str, ...]]]) -> bool:
    """Whether a tag ends a silent element that it doesn't name: where its end tag may be left out, or is missing.

    ``inner`` are the elements open inside it, which don't include ``tag`` if that is an end tag.
    """
    if closing:
        return silent == "option" or any(t == tag for t, _ in open_)
    if tag == "body":
        return silent != "template"
    if tag == silent:
        return tag in ("select", "button", "option")
    if silent in ("svg", "math"):
        return tag in _BLOCKS and not any(t in ("foreignobject", "desc", "annotation-xml") for t in inner)
    if tag in _CELLS and "table" not in inner:
        return silent != "template" and any(t == "table" for t, _ in open_)
    if silent == "option":
        last = open_[-1][0] if open_ else ""
        return tag == "optgroup" or (tag in _ITEMS and last in _ITEMS) or (tag in _CLOSES_P and last == "p")
    return False


class Block:
    """Text, the names of the open elements around it from the outside in, and its share of linked text."""

    __slots__ = ("text", "path", "names", "linked")

    def __init__(self, text: str, path: tuple[str, ...], names: frozenset[str], linked: float):
        self.text, self.path, self.names, self.linked = text, path, names, linked


def blocks(source: str | None) -> list[Block]:
    source = source or ""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    inside_link = linked = 0
    silent, inner = "", []

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            words = frozenset(w for _, names in open_ for w in names)
            out.append(Block(text, tuple(t for t, _ in open_), words, min(1.0, linked / len(text))))
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if not silent and text:
            parts.append(text)
            linked += len(text) if inside_link else 0

    at = 0
    while m := _TOKEN.search(source, at):
        take(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        opened = not closing and not m[3].rstrip().endswith("/")
        if tag in _RAW and opened:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if silent:
            if closing and tag in inner:
                while inner.pop() != tag:
                    pass
                continue
            if closing and tag == silent:
                silent = ""
                continue
            if not _ends(silent, tag, closing, inner, open_):
                if opened and tag not in _VOID:
                    inner.append(tag)
                continue
            silent = ""
        if tag in _SILENT and opened:
            silent, inner = tag, []
            continue
        if tag == "a":
            inside_link = 0 if closing else 1
        if tag == "br":
            take(" ")
        if tag not in _BLOCKS:
            continue
        flush()
        if closing:
            if any(t == tag for t, _ in open_):
                while open_.pop()[0] != tag:
                    pass
        elif tag not in _VOID:
            if tag in _CLOSES_P and open_ and open_[-1][0] == "p":
                open_.pop()
            if tag in ("li", "dt", "dd", "td", "tr") and open_ and open_[-1][0] == tag:
                open_.pop()
            words = [w for a, b, c in _NAMES.findall(m[3]) for w in _WORD.findall((a or b or c).lower())]
            open_.append((tag, (tag, *words)))
    take(source[at:])
    flush()
    return out


def teach(page: list[Block]) -> np.ndarray:
    """Labels from names: inside an element named as main text, and in none named otherwise."""
    return np.array([bool(b.names & _MAIN) and not b.names & _OTHER for b in page], float)


_BUCKET: dict[str, int] = {}


def _bucket(word: str, dims: int) -> int:
    known = _BUCKET.get(word)
    if known is None:
        if len(_BUCKET) > 300_000:
            _BUCKET.clear()
        known = _BUCKET[word] = zlib.crc32(word.encode("utf-8", "replace"))
    return known % dims


def vectors(page: list[Block], hidden: frozenset[str] = frozenset(), blurred: frozenset[str] = frozenset()) -> np.ndarray:
    """A row for each block: hashed tag path, hashed words, whether the path has names of main text or of other things,
    length, links, place and last character.  Names of one kind help each other: a page may have one that the sample hasn't.

    ``hidden`` names aren't seen at all; of ``blurred`` ones the kind is.
    """
    x = np.zeros((len(page), INPUTS), np.float32)
    for k, b in enumerate(page):
        shown = b.names - hidden
        for name in shown - blurred:
            x[k, _bucket(name, PATH_DIMS)] = 1
        x[k, -6:-4] = not shown.isdisjoint(_MAIN), not shown.isdisjoint(_OTHER)
        words = b.text.lower().split()
        x[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount([_bucket(w, WORD_DIMS) for w in words], minlength=WORD_DIMS) / len(words) ** 0.5
        x[k, -4:] = min(2.0, np.log1p(len(words)) / 4), b.linked, k / len(page), b.text[-1] in ".!?"
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one for each direction, and a logistic layer over both."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in ("f", "b"):
            self.p[f"w{d}"] = r.normal(0, 0.15, (INPUTS + HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        self.p["o"], self.p["ob"] = r.normal(0, 0.15, 2 * HIDDEN), np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, page, HIDDEN).  Where the mask is 0, the state passes unchanged."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out = np.zeros((steps, pages, HIDDEN))
        for t in range(steps) if d == "f" else reversed(range(steps)):
            joined = np.concatenate([x[t], h], 1)
            a = joined @ self.p[f"w{d}"] + self.p[f"c{d}"]
            f, i, o, g = _sigmoid(a[:, :HIDDEN]), _sigmoid(a[:, HIDDEN : 2 * HIDDEN]), _sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            s = np.tanh(new)
            if keep is not None:
                keep.append((t, joined, f, i, o, g, c, s, m))
            c = m * new + (1 - m) * c
            h = m * (o * s) + (1 - m) * h
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], 2)
        return _sigmoid(both @ self.p["o"] + self.p["ob"])

    def _learn(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        kept = {"f": [], "b": []}
        states = {d: self._run(x, mask, d, kept[d]) for d in kept}
        both = np.concatenate([states["f"], states["b"]], 2)
        error = (_sigmoid(both @ self.p["o"] + self.p["ob"]) - y) * mask / mask.sum()
        grads = {"o": np.einsum("tp,tph->h", error, both), "ob": np.array([error.sum()])}
        for k, d in enumerate(kept):
            w = self.p[f"w{d}"]
            gw, gc = np.zeros_like(w), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros_like(states[d][0]), np.zeros_like(states[d][0])
            out = self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            for t, joined, f, i, o, g, c, s, m in reversed(kept[d]):
                dh = dh + error[t][:, None] * out
                own, dnew = dh * m, dc * m
                dnew = dnew + own * o * (1 - s * s)
                da = np.concatenate([dnew * c * f * (1 - f), dnew * g * i * (1 - i), own * s * o * (1 - o), dnew * i * (1 - g * g)], 1)
                gw += joined.T @ da
                gc += da.sum(0)
                dh = (da @ w.T)[:, INPUTS:] + dh * (1 - m)
                dc = dnew * f + dc * (1 - m)
            grads[f"w{d}"], grads[f"c{d}"] = gw, gc
        return grads

    def fit(self, pages: list[list[Block]], passes: int = PASSES, batch: int = 24, rate: float = 0.02) -> "Labeller":
        """Adam over batches of pages, in windows of TRAIN_BLOCKS blocks."""
        r = np.random.default_rng(SEED)
        parts = [p[k : k + TRAIN_BLOCKS] for p in pages for k in range(0, len(p), TRAIN_BLOCKS)]
        mean, square, turn = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        names = sorted(_MAIN | _OTHER)

        def drawn(some: list[str], often: float) -> frozenset[str]:
            """Half of the names, on a page in so many; else none."""
            return frozenset(w for w in some if r.random() < 0.5) if r.random() < often else frozenset()

        others = sorted(_OTHER)

        def mixed(page: list[Block]) -> list[Block]:
            """A page on which some main text is said again inside an element of another kind."""
            out = []
            for b in page:
                out.append(b)
                if r.random() < 0.1 and b.names & _MAIN:
                    around = b.names - _MAIN if r.random() < 0.5 else b.names
                    out.append(Block(b.text, b.path, around | {others[int(r.integers(0, len(others)))]}, b.linked))
            return out

        for _ in range(passes):
            order = r.permutation(len(parts))
            for at in range(0, len(order), batch):
                some = [mixed(parts[k]) for k in order[at : at + batch]]
                shown = [vectors(p, drawn(names, 0.3), drawn(sorted(frozenset().union(*[b.names for b in p])), 0.6)) for p in some]
                x, mask = padded(shown)
                y = np.zeros(mask.shape)
                for k, p in enumerate(some):
                    y[: len(p), k] = teach(p)
                turn += 1
                for k, g in self._learn(x, mask, y).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (mean[k] / (1 - 0.9**turn)) / (np.sqrt(square[k] / (1 - 0.99**turn)) + 1e-8)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max((len(p) for p in pages), default=0)
    x, mask = np.zeros((steps, len(pages), INPUTS), np.float32), np.zeros((steps, len(pages)))
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def train(pages: DataFrame, sample: int = TRAIN_PAGES) -> Labeller:
    """Fits the labeller on ``sample`` different pages, or on all if there are fewer: those of the least hashes.

    Pages of more than TRAIN_CHARS characters aren't learnt from, as the sample comes to the driver.
    """
    marked = pages.filter(F.coalesce(F.length("html"), F.lit(0)) <= TRAIN_CHARS).select(F.xxhash64("html").alias("h"), "html")
    # equal pages have one hash, so a share is one of different pages
    n = marked.agg(F.approx_count_distinct("h")).first()[0]
    # twice as many as are needed, in expectation, so that a partition sorts a few pages only
    below = int(min(1.0, 2 * sample / max(n, 1)) * (1 << 63)) - 1
    near = marked.filter(F.col("h").bitwiseAND(F.lit((1 << 63) - 1)) <= below)
    chosen = near.dropDuplicates(["h"]).orderBy("h").limit(sample).collect() or marked.orderBy("h").limit(1).collect()
    found = [blocks(r["html"]) for r in chosen]
    return Labeller().fit([p for p in found if p])


def main_texts(sources: list[str | None], model: Labeller, at_once: int = 128, most_cells: int = 1 << 14) -> list[str]:
    read = [blocks(s) for s in sources]
    order = sorted(range(len(read)), key=lambda k: len(read[k]))
    texts = [""] * len(read)
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < at_once and len(read[order[to]]) * (to - at + 1) <= most_cells:
            to += 1
        group = [k for k in order[at:to] if read[k]]
        if group:
            scores = model.scores(*padded([vectors(read[k]) for k in group]))
            for n, k in enumerate(group):
                texts[k] = "\n\n".join(b.text for b, s in zip(read[k], scores[:, n]) if s >= 0.5)
        at = to
    return texts


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url and the main text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = main_texts(part.column("html").to_pylist(), model)
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string")
