"""Samples of tables that are mostly one repeated row, and white space of every kind."""

import itertools

import duckdb
from pyspark.sql import functions as F

from symgraph.llm import html, langid, queries

WORDS = ("zug", "vlok", "wrazz", "qop", "jyx", "zzyk")


def test_a_language_of_one_repeated_row_is_learnt(spark, documents):
    """A share is one of different texts: a row that is repeated doesn't push out the others of its language."""
    own = documents.filter("lang IS NOT NULL").select("doc_id", "text", "lang")
    words = F.lit(" ".join(WORDS * 2))
    hot = spark.range(5000).select((F.lit(10**6) + F.col("id")).alias("doc_id"), words.alias("text"), F.lit("xx").alias("lang"))
    some = [" ".join(p) for p in itertools.islice(itertools.permutations(WORDS), 0, 700, 35)]
    few = spark.createDataFrame([(2 * 10**6 + k, t, "xx") for k, t in enumerate(some)], "doc_id bigint, text string, lang string")
    docs = own.unionByName(hot).unionByName(few)
    model = langid.train(docs, F.lit(True), 60)
    assert "xx" in model.languages
    asked = few.unionByName(hot.limit(1))
    assert {r["lang_pred"] for r in langid.predict(asked, model).collect()} == {"xx"}


def test_pages_of_one_repeated_row_are_sampled(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    hot = spark.range(3000).select((F.lit(10**6) + F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.lit("<p>only this</p>").alias("html"))
    seen = []
    fit, html.Labeller.fit = html.Labeller.fit, lambda self, found: seen.extend(found) or self
    try:
        html.train(pages.unionByName(hot), 40)
    finally:
        html.Labeller.fit = fit
    assert len(seen) == 40


def test_quality_sql_on_white_space_of_every_kind(spark, tmp_path):
    texts = [
        "a b\tc\x0bd\x0ce\rf g\nh i j k", "one two\x0bthree four\x0cfive six\rseven eight nine ten eleven\n\x0b\n one two", "x\x85y z - , . ; : ! ? ' + =", "\x0b\x0c\r\n \t",
        "same words again and again same words again and again same words again and again", None, "",
    ]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    made = queries.op10_quality_rules(spark, str(tmp_path))
    names = sorted(made.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op10_quality_rules']})").fetchall()
    assert sorted(tuple(r) for r in made.select(*names).collect()) == sorted(want)
