"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import math

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, html, langid, lines, merkle, metric, minhash, packing, quality, ranked, substrings, warc
from .native import words_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_removed").alias("n_removed"),
        F.sha2(F.array_join(words_of(F.col("text")), " "), 256).alias("kept_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), added=True)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    done = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), ranks, pattern), ranks)
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
        F.col("whole").alias("whole_characters"),
    )


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages)).withColumn("n_chars", F.length("text").cast("bigint"))


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, index)


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_boilerplate(_table(spark, sf_dir, "documents"), host="source")
    return done.select(
        "doc_id",
        "source",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.length("text").cast("bigint").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op11_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_html_extract": op4_html_extract,
    "op5_warc_bundles": op5_warc_bundles,
    "op6_weighted_fingerprints": op6_weighted_fingerprints,
    "op7_line_dedup": op7_line_dedup,
    "op8_bagminhash": op8_bagminhash,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_topk": op11_vector_topk,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ranked_search": op13_ranked_search,
}

_LINES = r"""
WITH lined AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), own AS (
  SELECT DISTINCT source, text, ls FROM lined
), marks AS (
  SELECT DISTINCT source, text, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT source, text, unnest(ls) AS l FROM own)
), totals AS (
  SELECT source, count(*) AS total FROM own GROUP BY source
), bad AS (
  SELECT m.source, m.line FROM marks m JOIN totals t ON m.source IS NOT DISTINCT FROM t.source
  WHERE m.line <> '' GROUP BY m.source, m.line, t.total HAVING count(*) >= 5 AND count(*) > 0.02 * t.total
), grouped AS (
  SELECT source, list(line) AS bads FROM bad GROUP BY source
), cut AS (
  SELECT d.doc_id, d.source, d.text, d.ls,
         list_filter(d.ls, lambda l: NOT list_contains(coalesce(g.bads, []), trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS kept
  FROM lined d LEFT JOIN grouped g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, source, CAST(coalesce(len(ls), 1) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
       CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS kept_chars, sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM cut
"""

_SUBSTRINGS = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), first_doc AS (
  SELECT win, min(doc_id) AS least FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM wins JOIN first_doc USING (win) WHERE doc_id > least
), lost AS (
  SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(places, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""

_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages
), k AS (
  SELECT digest, max(page_id) AS latest, count(*) AS n FROM p WHERE size >= 1000 GROUP BY digest
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN size >= 1000 AND n > 1 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND n > 1 AND page_id < latest THEN latest END AS refers_to
FROM p LEFT JOIN k ON p.digest = k.digest
"""


#: Similar pairs by all shared shingles, and the least id that a document is linked with.
_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), bags AS (
  SELECT doc_id, sh, count(*) AS n FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS sh
    FROM w WHERE len(ws) > 0
  ) GROUP BY doc_id, sh
), sizes AS (
  SELECT doc_id, sum(n) AS total FROM bags GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS low FROM bags a JOIN bags b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 10 * low >= 8 * (p.total + q.total - low)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT DISTINCT doc_id AS id, doc_id AS least FROM w
  UNION SELECT ways.y, least FROM reach JOIN ways ON ways.x = reach.id
), least_of AS (
  SELECT id, min(least) AS class_id FROM reach GROUP BY id
)
SELECT d.doc_id, class_id FROM documents d LEFT JOIN least_of ON id = d.doc_id
"""


def _quality_sql() -> str:
    """Base features of whole texts; log-bucket sketches by language and source; fences; verdicts."""
    n, chars = "greatest(n_words, 1)", "CAST(word_chars AS DOUBLE)"
    values = {
        "symbol_ratio": f"CAST(n_symbols AS DOUBLE) / {n}",
        "repeat_ratio": f"CAST(n_repeat_words AS DOUBLE) / {n}",
        "dup_line_ratio": "CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1)",
        "word_length_high": f"{chars} / {n}",
        "word_length_low": f"{chars} / {n}",
    }
    fence, own, kept = [], [], []
    for name, (side, least) in quality.FENCES.items():
        part = "word_length_high" if name == "word_length_low" else name
        reach, spread = quality.REACH, "(q75 - q50)" if side == "high" else "(q50 - q25)"
        edge = f"q50 {'+' if side == 'high' else '-'} greatest({reach:e} * {spread}, {least:e})"
        fence.append(f"max(CASE WHEN feature = '{part}' THEN {edge} END) AS {name}, coalesce(max(CASE WHEN feature = '{part}' THEN total END), 0) AS n_{name}")
        own.append(f"{name}_tail" if name in quality.TAILS else name)
        kept.append(f"{values[name]} {'<=' if side == 'high' else '>='} f.{name}")
    for name, (reach, least) in quality.TAILS.items():
        edge = f"greatest(q50 + {reach:e} * (q75 - q50), {least:e})"
        fence.append(f"max(CASE WHEN feature = '{name}_tail' THEN {edge} END) AS {name}_tail, coalesce(max(CASE WHEN feature = '{name}_tail' THEN total END), 0) AS n_{name}_tail")
    names = list(quality.FENCES)

    def level(keys: str) -> str:
        by = f"{keys}, " if keys else ""
        group = f"GROUP BY {keys}" if keys else ""
        return f"""(
          SELECT {by}{', '.join(fence)} FROM (
            SELECT {by}feature, max(total) AS total, {', '.join(f"min(CASE WHEN upto >= {q:e} * total THEN value END) AS q{round(100 * q)}" for q in (0.25, 0.5, 0.75))} FROM (
              SELECT {by}feature, sum(n) OVER (PARTITION BY {by}feature) AS total, sum(n) OVER (PARTITION BY {by}feature ORDER BY bucket) AS upto,
                     CASE WHEN bucket = -1000000 THEN 0e0 ELSE 2 * pow({quality.GAMMA:e}, CAST(bucket AS DOUBLE)) / {quality.GAMMA + 1:e} END AS value
              FROM (SELECT {by}feature, bucket, sum(n) AS n FROM tailed GROUP BY {by}feature, bucket)
            ) GROUP BY {by}feature
          ) {group}
        )"""

    def tempered(k: str, wider: str) -> str:
        return f"(n_{k} * coalesce({k}, 0e0) + {quality.PRIOR} * {wider}) / (n_{k} + {quality.PRIOR})"

    sketched = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS feature, {v} AS v FROM measured WHERE NOT base_failed" for k, v in values.items() if k != "word_length_low")
    tails = ", ".join(f"'{k}'" for k in quality.TAILS)
    return rf"""
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (
      SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t
    ), wins AS (
      SELECT rid, i, list_slice(ws, i, i + 4) AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)
    ), twice AS (
      SELECT rid, win FROM wins GROUP BY rid, win HAVING count(*) > 1
    ), covered AS (
      SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM wins JOIN twice USING (rid, win)) GROUP BY rid
    ), measured AS (
      SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(ws) < 10 OR 100 * coalesce(n, 0) > 20 * len(ws) AS base_failed
      FROM w LEFT JOIN covered USING (rid)
    ), sketch AS (
      SELECT lang, source, feature, CASE WHEN v < 1e-6 THEN -1000000 ELSE CAST(ceil(ln(v) / {math.log(quality.GAMMA)!r}::DOUBLE) AS BIGINT) END AS bucket, count(*) AS n
      FROM ({sketched}) GROUP BY ALL
    ), tailed AS (
      SELECT * FROM sketch UNION ALL SELECT lang, source, feature || '_tail', bucket, n FROM sketch WHERE feature IN ({tails}) AND bucket > -1000000
    ), whole AS (SELECT {', '.join(f"coalesce({o}, {k}) AS all_{k}" for k, o in zip(names, own))} FROM {level('')}),
    langs AS (SELECT lang, {', '.join(f"{tempered(o, f'all_{k}')} AS lang_{k}" for k, o in zip(names, own))} FROM {level('lang')} CROSS JOIN whole),
    fences AS (
      SELECT o.lang, o.source, {', '.join(f"{tempered(o, f'lang_{k}')} AS {k}" for k, o in zip(names, own))}
      FROM {level('lang, source')} o JOIN langs l ON o.lang IS NOT DISTINCT FROM l.lang
    )
    SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {' AND '.join(f"coalesce({k}, true)" for k in kept)} AS kept
    FROM measured m LEFT JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
    """


_NEAREST = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid <> b.rid AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

_RANKED = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS did, doc_id, {"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"} AS ws FROM documents
), items AS (
  SELECT row_number() OVER () AS iid, item_id, {"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"} AS ws FROM benchmark
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM docs WHERE len(ws) > 0
), asked AS (
  SELECT iid, item_id, term, count(*) AS q FROM (SELECT iid, item_id, unnest(ws) AS term FROM items) GROUP BY ALL
), tfs AS (
  SELECT did, term, count(*) AS tf FROM (SELECT did, unnest(ws) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs CROSS JOIN whole GROUP BY term, n_docs
), sized AS (
  SELECT did, doc_id, 75 + (25 * CAST(len(ws) AS BIGINT) * n_docs) // n_terms AS m FROM docs CROSS JOIN whole WHERE len(ws) > 0
), sums AS (
  SELECT iid, item_id, did, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sized USING (did) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM sums WHERE score > 0) WHERE rank <= 20
"""


def _merkle_sql(leaf_levels: int = 6, source_levels: int = 3) -> str:
    """Leaves, the levels over them, and each leaf's way up, for up to 16 ** leaf_levels rows of a source."""
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode({v}::VARCHAR)) || ':' || {v} END"
    leaf = lambda text: "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bit = "lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),"
        f" lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), {bit})), 4294967295)"
    )
    upper, lower = merkle.UPPER, merkle.UPPER.lower()
    parts = [f"""
    WITH t AS (
      SELECT row_number() OVER () AS rid, doc_id, source, {leaf('text')} AS leaf,
             {leaf(f"(CASE WHEN {crc} % 5 = 0 THEN translate(text, '{upper}', '{lower}') ELSE text END)")} AS changed FROM documents
    ), n0 AS (
      SELECT *, coalesce('=' || source, '-') AS g, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM t
    )"""]

    def climb(tree: str, walk: str, levels: int, step: int) -> str:
        """Adds the levels of a tree (g, pos, total, h), and what a walk (here, f, proof) meets on them."""
        for k in range(levels):
            parts.append(f"""
    , {tree}r{k} AS (SELECT g, pos // 16 AS pos, max(total) AS total, list(h ORDER BY pos) AS hs FROM {tree}{k} GROUP BY g, pos // 16)
    , {tree}{k + 1} AS (SELECT g, pos, (total + 15) // 16 AS total, CASE WHEN total > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {tree}r{k})
    , {walk}{step + k + 1} AS (
      SELECT w.* EXCLUDE (here, f, proof), here // 16 AS here, CASE WHEN total > 1 THEN sha256(array_to_string(list_concat(list_concat(hs[1:here % 16], [f]), hs[here % 16 + 2:]), '')) ELSE f END AS f,
             CASE WHEN total > 1 THEN proof || array_to_string(list_concat(hs[1:here % 16], hs[here % 16 + 2:]), '') ELSE proof END AS proof
      FROM {walk}{step + k} w JOIN {tree}r{k} r ON r.g = w.g AND r.pos = w.here // 16
    )""")
        return f"{tree}{levels}"

    parts.append(", w0 AS (SELECT rid, doc_id, g, leaf, pos AS here, changed AS f, '' AS proof FROM n0)")
    subroots = climb("n", "w", leaf_levels, 0)
    parts.append(f""", m0 AS (SELECT '' AS g, g AS source_g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS total FROM {subroots})
    , v0 AS (SELECT rid, doc_id, leaf, h AS subroot, '' AS g, m0.pos AS here, f, proof FROM w{leaf_levels} w JOIN m0 ON m0.source_g = w.g)""")
    root = climb("m", "v", source_levels, 0)
    parts.append(f"SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM v{source_levels} CROSS JOIN {root} r")
    return "".join(parts)


ORACLES = {
    "op12_merkle_manifest": _merkle_sql(),
    "op13_ranked_search": _RANKED,
    "op11_vector_topk": _NEAREST,
    "op8_bagminhash": _NEAR,
    "op10_quality_rules": _quality_sql(),
    "op5_warc_bundles": _WARC,
    "op1_substring_dedup": _SUBSTRINGS, "op7_line_dedup": _LINES}
