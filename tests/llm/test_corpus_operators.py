"""Each operator against a brute-force version, and on odd rows."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from symgraph.llm import bpe, fingerprints, html, langid, lines, minhash, native, packing, quality, substrings, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def empty(df):
    return df.limit(0)


# 1. substring dedup


def cut(docs):
    made = substrings.remove_repeats(docs).select("doc_id", "text", "__n_words", "__n_removed")
    return sorted(((r[0], words(r[1]), r[2], r[3]) for r in made.collect()), key=repr)


def cut_plainly(rows):
    holders = collections.defaultdict(set)
    for d, text in rows:
        w = words(text)
        for i in range(len(w) - 49):
            if d is not None:
                holders[tuple(w[i : i + 50])].add(d)
    out = []
    for d, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - 49):
            if d is not None and min(holders[tuple(w[i : i + 50])]) < d:
                gone.update(range(i, i + 50))
        out.append((d, [x for i, x in enumerate(w) if i not in gone], len(w), len(gone)))
    return sorted(out, key=repr)


def test_substrings(odd, documents):
    for docs in (odd, documents):
        assert cut(docs) == cut_plainly([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = substrings.remove_repeats(odd)
    assert kept.columns[: len(odd.columns)] == odd.columns
    assert kept.filter("doc_id = 3").first()["text"] is None
    assert substrings.remove_repeats(empty(odd)).count() == 0


def test_substrings_of_hot_ids(spark):
    """Null and repeated ids are dealt to all buckets, and still take nothing from each other."""
    passage = " ".join(f"q{i}" for i in range(70))
    rows = [(None, f"{passage} n{i}") for i in range(40)] + [(7, f"{passage} r{i}") for i in range(40)] + [(8, f"x {passage}")] + [(9, passage)] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert cut(docs) == cut_plainly(rows)


def test_cover_meets_all_pairs():
    on = set(substrings.COVER)
    v = substrings.PERIOD
    assert all(any((i + s) % v in on and (j + s) % v in on for s in range(v)) for i in range(v) for j in range(v))


# 2. packing


def test_packing(odd, documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    for docs in (odd, documents.limit(80)):
        want = collections.Counter()
        for r in docs.collect():
            ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
            want[r["doc_id"], len(ids)] += 1
        made = packing.pack(docs, path).collect()
        by = collections.defaultdict(list)
        for p in made:
            by[p["doc_id"], p["doc_tokens"]].append(p)
        for (d, n), times in want.items():
            assert sum(p["length"] for p in by[d, n]) == n * times
        used = collections.defaultdict(list)
        for p in made:
            used[p["sequence_id"]].append((p["offset"], p["length"]))
        for s in used.values():
            at = 0
            for o, n in sorted(s):
                assert o == at
                at += n
            assert at <= packing.CAPACITY
    one = {r["doc_id"]: r["text"] for r in documents.limit(80).collect()}
    for p in made:
        ids = np.array(tokenizer.encode(one[p["doc_id"]] or "", add_special_tokens=False).ids + [2], "<u4")
        assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    assert packing.pack(empty(odd), path).count() == 0


def test_patterns_fit_and_fill():
    r = np.random.default_rng(3)
    lengths = np.minimum(64, r.geometric(0.06, 5000))
    sizes, demand = np.unique(lengths, return_counts=True)
    found = packing.patterns(sizes, demand.astype(float), 64)
    filled = sum(times * int(p @ sizes) for times, p in found)
    assert all(p @ sizes <= 64 for _, p in found)
    assert (sum(times * p for times, p in found) <= demand).all()
    assert filled >= 0.98 * 64 * sum(times for times, _ in found)
    assert filled >= 0.8 * int(lengths.sum())


def test_word_ids_equal_whole_texts():
    encode = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["A.B, c.. d., it's e.’ Ünïcode. ΑΣ. 12.5, x y.\nz", "", "<|endoftext|>. a", "l'été. İ. ẞ,"]
    for t in texts:
        direct = encode.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode([t.encode()])[0], "<u4").tolist() == direct, t


# 3. byte-level BPE


def test_bpe_equals_library(odd, documents):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (odd, documents.limit(40)):
        made = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()
        want = collections.Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in docs.collect())
        assert collections.Counter((r["doc_id"], tuple(r["ids"]), bytes(r["data"])) for r in made) == want
        assert all(r["whole"] for r in made)
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 40):
        for _ in range(200):
            ids = r.integers(0, 50256, n).tolist()
            data = b"".join(codec.decoder.bytes_of[i] for i in ids)
            assert "".join(codec.decoder.stream(ids)) == data.decode("utf-8", "replace")
            try:
                data.decode()
                whole = True
            except UnicodeDecodeError:
                whole = False
            assert codec.decoder.whole(ids) == (data, whole)
    for text in ("a" * 2000, " " * 300, "aab" * 300, "\n\n  \n", "=-=-" * 50):
        assert codec.encode(text) == library.encode_ordinary(text)


# 4. html


PAGES = "page_id bigint, url string, html string, text string"


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html.train(pages, 40)
    odd = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<p>", "t"), (4, "u", "<article>" + "<p>one &amp; <b>two</p>" * 3000, "t")], PAGES)
    got = {r["page_id"]: r["text"] for r in html.extract(odd, model).collect()}
    assert got[1] == got[2] == got[None] == ""
    assert got[4] == "\n\n".join(["one & two"] * 3000)
    wrong = 0
    for r in html.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        blocks = html.blocks(r["html"])
        want = "\n\n".join(b.text for b, y in zip(blocks, html.teach(blocks)) if y)
        wrong += r["text"] != want
    assert wrong == 0
    assert html.extract(empty(pages), html.train(empty(pages))).count() == 0


def test_blocks():
    found = html.blocks("<title>t</title><nav><a href=x>m</a></nav><p>a <b>b<br>c<p>d&nbsp;&lt;<script>if (a<b) '</p>'</script> e<!-- x --> f<ul><li>g<li>h</ul>i")
    assert [b.text for b in found] == ["m", "a b c", "d < e f", "g", "h", "i"]
    assert found[0].linked == 1 and "nav" in found[0].names


def test_labeller_gradients():
    r = np.random.default_rng(1)
    model = html.Labeller()
    x, mask = r.normal(size=(5, 3, html.INPUTS)), np.ones((5, 3))
    mask[3:, 1] = 0
    y = (r.random((5, 3)) < 0.5).astype(float)
    loss = lambda: -float((mask * (y * np.log(model.scores(x, mask)) + (1 - y) * np.log(1 - model.scores(x, mask)))).sum() / mask.sum())
    for name, g in model._learn(x, mask, y).items():
        at = tuple(int(r.integers(0, n)) for n in g.shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        assert math.isclose((up - loss()) / 2e-5, g[at], abs_tol=1e-6), name
        model.p[name][at] = old


# 5. WARC


def test_warc(spark):
    big = "x" * 2000
    rows = [(1, "http://a", big), (3, "http://b\r\nX: y", big), (2, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (6, "u", None), (None, "u", big), (7, "é", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    folder, index = warc.write(pages)
    got = sorted((tuple(r) for r in warc.read(spark, folder, index).collect()), key=repr)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = h == big and p != 3
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=repr)
    from pathlib import Path

    for r in index.filter("page_id = 7").collect():
        data = Path(folder.removeprefix("file://"), r["bundle"]).read_bytes()
        headers, block = warc.read_record(data, r["frame"], r["offset"])
        assert headers["WARC-Record-ID"] == r["record_id"] and block.endswith(("é" * 600).encode())
    folder, index = warc.write(empty(pages))
    assert warc.read(spark, folder, index).count() == 0


# 6. fingerprints


def test_fingerprints(odd, documents):
    for docs in (odd, documents):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        got = collections.defaultdict(list)
        for r in fingerprints.fingerprint_neighbours(docs).collect():
            got[r["doc_id"]].append(r)
        errors, prints = [], {}
        for k, (d, text) in enumerate(rows):
            after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
            edited = text[: len(text) - half] + (after[:half] if half else "")
            sha = hashlib.sha256(edited.encode()).hexdigest()
            r = next(x for x in got[d] if x["edited_sha256"] == sha and x["n_chars"] == len(text))
            assert prints.setdefault(tuple(sorted(words(text))), r["fingerprint"]) == r["fingerprint"]
            a, b, c = (collections.Counter(words(t)) for t in (text, edited, after))
            for near, other in ((r["near_edited"], b), (r["near_next"], c)):
                high = sum((a | other).values())
                errors.append(near - (sum((a & other).values()) / high if high else 1.0))
        assert sum(map(len, got.values())) == len(rows)
        assert max(map(abs, errors)) < 0.3 and abs(np.mean(errors)) < 0.02
    assert fingerprints.fingerprint_neighbours(empty(odd)).count() == 0


# 7. line dedup


def test_lines(spark, odd):
    made = lines.drop_boilerplate(odd)
    assert made.columns[: len(odd.columns)] == odd.columns and made.count() == odd.count()
    assert lines.drop_boilerplate(empty(odd)).count() == 0
    rows = [(i, f"menu\nown text of page {i} goes on for a while\n menu2 " if i else "menu", None if i % 2 else "h") for i in range(40)]
    pages = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["text"], r["__n_dropped"]) for r in lines.drop_boilerplate(pages).collect()}
    assert got[0] == ("", 1)  # nothing else is left of it
    assert all(got[i] == (f"own text of page {i} goes on for a while", 2) for i in range(1, 40))
    copies = spark.createDataFrame([(i, "copied\nwhole", "h") for i in range(30)], pages.select("doc_id", "text", "source").schema)
    both = {r["doc_id"]: r["__n_dropped"] for r in lines.drop_boilerplate(pages.filter("source IS NOT NULL").union(copies)).collect()}
    assert both[1] == 0  # one page, however often it is there
    small = {r["doc_id"]: r["__n_dropped"] for r in lines.drop_boilerplate(pages.filter("doc_id in (2, 4)")).collect()}
    assert small == {2: 0, 4: 0}


def test_join_beyond_the_bound(spark):
    big = spark.createDataFrame([(i, None if i % 3 else "k", i) for i in range(100)], "id bigint, k string, v bigint")
    few = spark.createDataFrame([(None, 1), ("k", 2)], "k string, w bigint")
    plain = sorted(map(tuple, native.join_bounded(big, few, ["k"]).collect()))
    assert sorted(map(tuple, native.join_bounded(big, few, ["k"], most=1, salts=8).collect())) == plain
    assert {(r[1], r[3]) for r in plain} == {(None, 1), ("k", 2)} if plain[0][1] is None else True


# 8. near-duplicates


def bags(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def classes_plainly(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = [(d, bags(t)) for d, t in rows if d is not None and words(t)]
    for i, (a, x) in enumerate(listed):
        for b, y in listed[:i]:
            low = sum((x & y).values())
            if low and 10 * low >= 8 * sum((x | y).values()):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def test_near_duplicates(spark, odd, documents):
    base = [f"t{i}" for i in range(200)]
    chain = [(1000 + k, " ".join(base[:150] if k == 0 else [*base[: 8 * k], *base[8 * k : 150 + 3 * k]])) for k in range(12)]
    heavy = [(2000, "a b c d e " * 500), (2001, "a b c d e " * 420), (2002, "a b c d e " * 100)]
    made = spark.createDataFrame(chain + heavy, "doc_id bigint, text string")
    for docs in (odd, documents, made):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = minhash.classes(docs).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == classes_plainly(rows)
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(
        (d or 0) for d in [r["doc_id"] for r in odd.collect()] if d is None or classes_plainly([(r["doc_id"], r["text"]) for r in odd.collect()])[d] == d
    )
    assert minhash.classes(empty(odd)).count() == 0


def test_near_duplicates_of_large_buckets(spark, monkeypatch):
    """Members of large buckets are compared in cells; texts that share an id are told apart and share a class."""
    r = np.random.default_rng(7)
    base, rows = [f"t{i}" for i in range(120)], []
    for k in range(90):
        text = list(base)
        for _ in range(int(r.integers(0, 6))):
            text[int(r.integers(0, 120))] = f"z{r.integers(0, 10**6)}"
        rows.append((k + 1, " ".join(text)))
    rows += [(3, rows[60][1] + " q"), (3, "totally other words here for id three yes it is"), (500, "totally other words here for id three yes it is")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = classes_plainly(rows)
    monkeypatch.setattr(minhash, "SMALL", 2)
    for block in (16, 2048):
        assert {x["doc_id"]: x["class_id"] for x in minhash.classes(docs, block=block).collect()} == want


def test_signatures_are_unbiased():
    r = np.random.default_rng(2)
    n, m = 300, 288
    agree, wanted = [], []
    for _ in range(40):
        a = r.integers(0, 9, n) * (r.random(n) < 0.7)
        b = np.where(r.random(n) < 0.6, a, r.integers(0, 9, n))
        h = r.integers(1, 1 << 62, n).astype(np.uint64)
        texts = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        made = minhash.signatures(texts, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, m)
        agree.append((made[0] == made[1]).mean())
        wanted.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(np.array(agree) - wanted)) < 0.01


# 9. language


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs, ~held, 60)
    right = langid.predict(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert right.filter("lang = lang_pred").count() >= 0.97 * right.count()
    got = langid.predict(odd, model).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == odd.count()
    nothing = langid.train(empty(docs), F.lit(True))
    assert nothing.predict("some text") == ("und", 0.0)
    assert langid.predict(empty(odd), model).count() == 0


# 10. quality rules


def base_plainly(text):
    text = text or ""
    w = words(text)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    full = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality(odd, documents):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for docs in (odd, documents):
        got = collections.Counter((r["doc_id"], *[r[c] for c in names]) for r in quality.judge(docs).collect())
        assert got == collections.Counter((r["doc_id"], *base_plainly(r["text"])) for r in docs.collect())
    kept = quality.filter_quality(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} <= {1, 2, 6, 7, 8, None, 12}
    assert quality.judge(empty(odd)).count() == 0


def test_quality_verdicts(documents):
    """Fences from sketches, worked out again in Python."""
    rows = [r.asDict() for r in quality.features(documents).collect()]

    def values(r):
        n = max(1, r["n_words"])
        return {"symbol_ratio": r["n_symbols"] / n, "repeat_ratio": r["n_repeat_words"] / n, "dup_line_ratio": r["n_dup_lines"] / max(1, r["n_lines"]), "word_length": r["word_chars"] / n}

    def sketch(some):
        return {k: sorted(-1_000_000 if values(r)[k] < 1e-6 else math.ceil(math.log(values(r)[k]) / math.log(quality.GAMMA)) for r in some) for k in values(rows[0])}

    def quantile(buckets, q):
        b = buckets[max(0, math.ceil(q * len(buckets)) - 1)]
        return 0.0 if b == -1_000_000 else 2 * quality.GAMMA**b / (quality.GAMMA + 1)

    def fences(some):
        found, out = sketch(some), {}
        for name, (side, least) in quality.FENCES.items():
            key = "word_length" if name.startswith("word_length") else name
            buckets, n = found[key], len(some)
            if name in quality.TAILS:
                above = [b for b in buckets if b > -1_000_000]
                if above:
                    reach, floor = quality.TAILS[name]
                    q = [quantile(above, x) for x in (0.5, 0.75)]
                    out[name] = len(above), max(q[0] + reach * (q[1] - q[0]), floor)
                    continue
                n = 0
            q = [quantile(buckets, x) for x in (0.25, 0.5, 0.75)]
            out[name] = n, q[1] + max(quality.REACH * (q[2] - q[1]), least) if side == "high" else q[1] - max(quality.REACH * (q[1] - q[0]), least)
        return out

    def tempered(own, wider):
        return {k: (n * v + quality.PRIOR * wider[k]) / (n + quality.PRIOR) for k, (n, v) in own.items()}

    past = [r for r in rows if not r["base_failed"]]
    langs, groups = collections.defaultdict(list), collections.defaultdict(list)
    for r in past:
        langs[r["lang"]].append(r)
        groups[r["lang"], r["source"]].append(r)
    whole = {k: v for k, (_, v) in fences(past).items()}
    of_lang = {k: tempered(fences(some), whole) for k, some in langs.items()}
    of = {k: tempered(fences(some), of_lang[k[0]]) for k, some in groups.items()}
    want = {}
    for r in rows:
        ok = not r["base_failed"]
        for name, (side, _) in quality.FENCES.items() if ok else ():
            key = "word_length" if name.startswith("word_length") else name
            fence = of[r["lang"], r["source"]][name]
            ok = ok and (values(r)[key] <= fence if side == "high" else values(r)[key] >= fence)
        want[r["doc_id"]] = ok
    assert {r["doc_id"]: r["kept"] for r in quality.judge(documents).collect()} == want


# the pipeline


def plain_lines(rows):
    """(doc_id, text) after lines on over 2 % and at least five of a source's distinct pages are gone."""
    pages = collections.defaultdict(set)
    for r in rows:
        pages[r["source"]].add(r["text"])
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    bad = {}
    for source, texts in pages.items():
        seen = collections.Counter(x for t in texts if t is not None for x in {strip(x) for x in t.split("\n")} if x)
        bad[source] = {x for x, n in seen.items() if n >= 5 and n > 0.02 * len(texts)}
    return {r["doc_id"]: None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if strip(x) not in bad[r["source"]]) for r in rows}


def test_pipeline_equals_plain_versions(spark, documents, tmp_path):
    """Each stage's rows against a plain version over what the stage before it kept."""
    import corpus_pipeline

    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = [r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()]
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}  # see test_quality_verdicts
            assert sorted(map(repr, new)) == sorted(repr(r) for r in old if r["doc_id"] in want)
        elif name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in new} == plain_lines(old) and len(new) == len(old)
            assert all(r["n_chars"] == len(r["text"]) for r in new)
        elif name == "near_duplicates":
            least = classes_plainly([(r["doc_id"], r["text"]) for r in old])
            assert sorted(map(repr, new)) == sorted(repr(r) for r in old if least[r["doc_id"]] == r["doc_id"])
        elif name == "substring_dedup":
            assert sorted(((r["doc_id"], words(r["text"])) for r in new)) == sorted((d, w) for d, w, *_ in cut_plainly([(r["doc_id"], r["text"]) for r in old]))
        else:
            of = collections.defaultdict(list)
            for p in new:
                of[p["doc_id"]].append((p["start"], p["length"]))
            assert set(of) == {r["doc_id"] for r in old}
            for d, spans in of.items():
                at = 0
                for start, length in sorted(spans):
                    assert start == at
                    at += length
            filled, sequences = sum(p["length"] for p in new), len({p["sequence_id"] for p in new})
            assert filled > 0.98 * packing.CAPACITY * (sequences - 1)
        docs = after
    assert docs.count() > 0


def test_pipeline(spark, tmp_path, odd):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
    assert docs.agg(F.count("*")).first()[0] > 0
    left = {r["doc_id"] for r in docs.collect()}
    assert 1 in left and 2 not in left and 4 not in left
    docs = odd.limit(0).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"), "key", "comp", "line")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / f"empty-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"empty-{name}"))
        assert docs.count() == 0
