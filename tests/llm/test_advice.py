"""Places where an operator once did less than its whole job."""

import collections
import zlib

import numpy as np
import public_tokenizers

from symgraph.llm import html, packing, quality, queries

# 2. packing

IDS = [
    "x <|endoftext|> y",
    "A.<|endoftext|>,b<|startoftext|>Hello. <|EndOfText|> <|endoftext|",
    "H\u0331 T\u0308. W\u030a Y\u030A, J\u030c H \u0331 \u00c9t\u00e9. NA\u00cfVE, It's \u0130\u03a3 E\u0301. A\u0308.\u0338 B",
    "",
]


def untouched():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_equal_those_of_an_untouched_tokenizer():
    library, encode = untouched(), packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), added=True)
    for text in IDS:
        got = np.frombuffer(encode([text.encode()])[0], "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


def test_packing_query_has_the_ids_of_an_untouched_tokenizer(spark, tmp_path):
    rows = list(enumerate(IDS))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = collections.Counter()
    for k, text in rows:
        ids = np.array(untouched().encode(text, add_special_tokens=False).ids + [packing.END], "<u4")
        want[k, len(ids), zlib.crc32(ids.tobytes())] += 1
    made = queries.op2_packing(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in made) == want



# 4. html


def test_blocks_after_silent_elements():
    def texts(source):
        return [(b.text, b.path) for b in html.blocks(source)]

    after = [("menu", ("nav",)), ("Hello", ("article", "p"))]
    rest = "<nav>menu</nav><article><p>Hello</p></article>"
    assert texts("<script>var s = '<!--';</script>" + rest) == after
    assert texts("<template><script>'</template><!--'</script>x</template>" + rest) == after
    assert texts("<style>a</style foo>" + rest) == after
    said = "<article><p>I don't know</p></article><p>it's</p>"
    assert texts("<script>if(a<b){x=1} // it's</script>" + said) == [("I don't know", ("article", "p")), ("it's", ("p",))]
    assert texts("<head><title>t</title><meta a>" + rest) == after
    assert texts("<head><title>t</title><noscript><link a><body>" + rest) == [(x, ("body", *p)) for x, p in after]
    assert texts("<select><option>a<option>b</select>" + rest) == after
    assert texts("<datalist><option>a<option>b</datalist>" + rest) == after
    assert texts("<div><button>a<button>b<p>c</p></div>" + rest) == after
    assert texts("<div><object>a</div>" + rest) == after
    assert texts("<svg><path d='1'/><g>a" + rest) == after
    assert texts("<svg><foreignObject><p>a</p></foreignObject></svg>" + rest) == after
    assert texts("<object><object>a</object><div>b</div></object>" + rest) == after


def test_quotes_in_tags():
    found = [b.text for b in html.blocks("<p title=it's>one</p><p>two's</p><p data-a='x > y' b=\"<p>\">three</p><p a=\"open>four</p>")]
    assert found == ["one", "two's", "three", "four"]


def test_main_text_written_by_hand(spark):
    """Pages whose main text was picked by a person, beside what pages have around it."""
    nav = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>Contact us</a></li></ul></nav>"
    foot = "<footer>&copy; 2024 somebody. All rights reserved.</footer>"
    ad = "<div class='ad'>Buy two, get one free today.</div>"
    form = "<form><label>Your mail</label><input name=m><button>Send</button></form>"
    said = "<section class='comments'><div class='comment'><p>I liked this very much, thanks.</p></div></section>"
    rows = [
        (1, f"<html><head><title>t</title><body>{nav}<article><h1>On  tides</h1><p>The sea rises &amp; falls\ntwice a day.</p>{ad}<p>Moon and sun pull it.</p></article>{said}{foot}", "On tides\n\nThe sea rises & falls twice a day.\n\nMoon and sun pull it."),
        (2, f"<body><header>The Daily</header>{nav}<article><p>Prices rose by 3&nbsp;% in May.<script>var a = '<p>no</p>'</script></p><ul><li>Bread rose by five cents a loaf.<li>Milk stayed as it was.</ul></article><aside>Read more</aside>{form}{foot}</body>", "Prices rose by 3 % in May.\n\nBread rose by five cents a loaf.\n\nMilk stayed as it was."),
        (3, f"{nav}{ad}{foot}", ""),
    ]
    pages = spark.createDataFrame([(k, "u", source) for k, source, _ in rows], "page_id bigint, url string, html string")
    model = html.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert {r["page_id"]: r["text"] for r in html.extract(pages, model).collect()} == {k: want for k, _, want in rows}


# 10. quality rules


def test_quality_fences_below_the_base_rules(spark):
    """Outliers that the base rules let pass go by fences from the values above zero."""
    rows = []
    for i in range(600):
        few = 2 if i % 5 == 0 else 0
        rows.append((i, 100, 800, 0, few, few + i % 3 if few else 0, 20, False))
    rows.append((1000, 100, 800, 0, 0, 19, 20, False))
    rows.append((1001, 100, 800, 0, 9, 0, 20, False))
    rows.append((1002, 100, 600, 0, 0, 0, 20, False))
    names = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, base_failed boolean"
    measured = spark.createDataFrame(rows, names).selectExpr("*", "'en' AS lang", "'a' AS source")
    fences = quality.thresholds(measured)
    assert quality._verdict(measured.join(fences, ["lang", "source"])).filter("NOT kept").count() == 3
    none = quality.thresholds(measured.filter("doc_id % 5 = 1 AND doc_id < 600")).first()
    assert none["repeat_ratio"] == quality.FENCES["repeat_ratio"][1]  # no values above zero
