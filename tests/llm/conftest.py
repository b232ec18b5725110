import pytest

#: Names that operators use for columns of their own.
CLASHES = ["n", "key", "doc", "comp", "bucket", "pid", "line", "lines", "pages", "total", "rows", "kept", "word", "lang_pred", "base"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""
    long_ = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "a"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "a"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n ", "de", "b"),
        (6, long_, "de", None),
        (7, f"one two {passage} three", "fr", "b"),
        (8, f"{passage}\nfour", "fr", "b"),
        (None, f"five {passage}", None, "c"),
        (9, "été naïve 中文 \U0001f600 #$% 1234", "fr", "c"),
        (10, "same line\nsame line\nother line", "es", "c"),
        (11, "x", "es", "c"),
        (12, "don't STOP, it's 'fine'... <|endoftext|> a.b. İΣ", "en", "c"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], schema)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
