"""Operators on small tables made for them."""

from pyspark.sql import functions as F

from symgraph.functions import text
from symgraph.operators import graph, lookup, rank, resolve, store

EDGES = "src_id string, dst_id string, type string, confidence string, path string, line bigint"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "calls", "exact", "f", k) for k, (a, b) in enumerate(pairs)], EDGES)


def reached(df):
    return {(r["root"], r["id"]): r["distance"] for r in df.collect()}


def test_traverse_cycle_diamond_and_caps(spark):
    e = edges(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), ("a", "a"), ("x", "ghost")])
    roots = spark.createDataFrame([("a", "a"), ("ghost", "ghost")], "root string, id string")
    assert reached(graph.traverse(e, roots, 6)) == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("ghost", "x"): 1}
    assert reached(graph.traverse(e, roots.filter("id = 'a'"), 6, max_nodes=1)) == {("a", "b"): 1}
    assert reached(graph.traverse(e, roots, 2, types=("imports",))) == {}
    via = {r["id"]: r["via"]["dst_id"] for r in graph.traverse(e, roots, 6).collect()}
    assert via["d"] == "b"


def test_shortest_paths(spark):
    e = edges(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("e", "f")])
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "f")], "a string, b string")
    got = {(r["a"], r["b"]): (r["length"], [(h["src_id"], h["dst_id"]) for h in r["hops"]]) for r in graph.shortest_paths(e, pairs).collect()}
    assert got == {("a", "d"): (3, [("a", "b"), ("c", "b"), ("c", "d")]), ("a", "a"): (0, [])}


def test_budget_prefix_latches(spark):
    lines = spark.createDataFrame([(1, "g", "a" * 40), (2, "g", "b" * 400), (3, "g", "c")], "k int, g string, line string")
    assert [r["k"] for r in rank.within_budget(lines, 60, ["g"], ["k"]).collect()] == [1]
    assert rank.clamp_budget(5) == 120 and rank.clamp_budget(None) == 1200 and rank.clamp_budget(10**9) == 20_000


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    assert one(text.suffixes(F.lit("a/b/c"), "/")) == ["b/c", "c"] and one(text.suffixes(F.lit("a"), "/")) == []
    assert [one(text.plural(F.lit(n), F.lit(w))) for n, w in ((1, "class"), (2, "class"), (2, "entry"), (2, "day"), (0, "file"))] == ["class", "classes", "entries", "days", "files"]
    assert [one(text.duration(F.lit(ms))) for ms in (12.4, 1500.0, 61_000.0)] == ["12ms", "1.5s", "1m 1s"]
    assert [one(text.language(F.lit(p))) for p in ("a/b.py", "b.d.TS", ".py", "x", "q.ddl")] == ["python", "typescript", None, None, "sql"]
    assert [one(text.dirname(F.lit(p))) for p in ("a/b/c", "c")] == ["a/b", ""]
    assert one(text.normal_path(F.lit("./a/../b/./c"))) == "b/c"
    assert one(text.bare_identifier(F.lit('public."Users"'))) == "users"
    assert one(text.line_at(F.lit("a\nb\nc"), F.lit(4))) == 3
    assert tuple(one(text.split_qualified(F.lit("a.b::c")))) == ("a.b", "c")
    assert one(text.first_paragraph(F.lit("  one\ntwo \n\nthree"))) == "one two" and one(text.first_paragraph(F.lit("--\n\nx"))) is None
    scores = [one(text.fuzzy_millis("abc", F.lit(s))) for s in ("abc", "abcd", "xabc", "a_b_c", "acb")]
    assert scores == [0, 1004, 11_004, 102_005, None]


def test_ladder_first_rung_wins(spark):
    rows = [("r:src/m.py:method:K.f", "f", "K.f", "src/m.py", "src.m"), ("r:src/m.py:class:F", "F", "F", "src/m.py", "src.m")]
    nodes = spark.createDataFrame(rows, "id string, name string, qualified string, path string, module string")
    names = spark.createDataFrame([(q,) for q in ("r:src/m.py:class:F", "src/m.py:K.f", "K.f", " f ", "src.m.K.f", "m.f", "zzz.f", "K.F", "g", "k.f", "")], "q string")
    got = {(r["q"], r["rung"], r["id"].rsplit(":", 1)[-1]) for r in lookup.ladder(names, nodes).collect()}
    assert got == {
        ("r:src/m.py:class:F", "id", "F"), ("src/m.py:K.f", "in_file", "K.f"), ("K.f", "qualified", "K.f"), ("f", "name", "K.f"), ("src.m.K.f", "dotted", "K.f"),
        ("m.f", "dotted", "K.f"), ("zzz.f", "last_segment", "K.f"), ("K.F", "last_segment", "F"), ("k.f", "last_segment", "K.f"),
    }


def test_resolution_gates(spark):
    defs = spark.createDataFrame([(f"d{i}", n, f"p{i}", s, "function", True) for i, (n, s) in enumerate([("a", "x"), ("b", "x"), ("b", "y"), *[("c", "z")] * 5])], "id string, name string, path string, scope string, kind string, exported boolean")
    refs = spark.createDataFrame([(1, "p0", "a", None, "q"), (2, "o", "b", None, "x"), (3, "o", "b", None, "q"), (4, "o", "c", None, "q"), (5, "o", "b", "q", "q")], "rid bigint, path string, name string, qualifier string, scope string")
    got = {(r["rid"], r["id"], r["confidence"]) for r in resolve.resolve_names(refs, defs).collect()}
    assert got == {(1, "d0", "exact"), (2, "d1", "resolved"), (3, "d1", "heuristic"), (3, "d2", "heuristic")}


def test_placed_imports_and_rungs(spark):
    """A barrel, a rename, a cycle of stars, a default, a submodule; and each rung on one reference."""
    from symgraph.operators import ladder

    kinds = [("a", "f", "f", "function"), ("a", "K", "K", "class"), ("a", "m", "K.m", "method"), ("lib", "g", "g", "function"), ("lib", "h", "h", "function"), ("lib", "B", "B", "class"), ("lib", "up", "B.up", "method"), ("far", "z", "z", "function"), ("far", "t", "t", "table")]
    rows = [(f"{p}:{q}", f"{p}.py", n, q, k, True) for p, n, q, k in kinds] + [(f"{p}:", f"{p}.py", p, p, "module", True) for p in ("a", "lib", "far", "barrel", "pkg/sub")]
    nodes = spark.createDataFrame(rows, "id string, path string, name string, qualified string, kind string, exported boolean")
    mods = spark.createDataFrame([(f"{p}.py", "python", p.replace("/", "."), False) for p in ("a", "lib", "far", "barrel", "pkg/sub")], "path string, family string, module string, is_alias boolean")
    imports = spark.createDataFrame(
        [
            (1, "a.py", "python", "lib", None, "l"), (2, "a.py", "python", "barrel", "gg", "gg"), (3, "barrel.py", "python", "lib", "g", "gg"), (4, "barrel.py", "python", "a", None, None),
            (5, "a.py", "python", "barrel", None, None), (6, "a.py", "python", "pkg", "sub", "sub"), (7, "a.py", "python", "lib", "default", "d"), (8, "a.py", "python", "os", None, "os"),
            (9, "a.py", "python", "barrel", "nowhere", "nw"), (10, "a.py", "python", "lib", "B", "Base"),
        ],
        "rid bigint, path string, family string, module string, symbol string, alias string",
    )
    placed = ladder.place_imports(imports, mods, nodes)
    got = {r["rid"]: (r["id"], r["via"]) for r in placed.collect()}
    assert got == {
        1: ("lib:", None), 2: ("lib:g", "barrel:"), 3: ("lib:g", None), 4: ("a:", None), 5: ("barrel:", None), 6: ("pkg/sub:", None), 7: ("lib:g", None), 9: ("barrel:", None), 10: ("lib:B", None),
    }
    bases = spark.createDataFrame([("a:K", "lib:B")], "owner string, base string")
    refs = spark.createDataFrame(
        [
            (1, "a:K.m", "queries", "t", None), (2, "a:K.m", "calls", "m", "self"), (3, "a:K.m", "calls", "up", "this"), (4, "a:f", "calls", "f", None), (5, "a:f", "calls", "gg", None),
            (6, "a:f", "calls", "h", "l"), (7, "a:f", "calls", "up", "Base"), (8, "a:f", "calls", "m", "K"), (9, "a:f", "references", "h", "x.y"), (10, "a:f", "calls", "z", None),
            (11, "a:f", "calls", "z", "x"), (12, "a:f", "calls", "m", None), (13, "a:f", "calls", "q", None), (14, "a:f", "calls", "q", "x"),
        ],
        "rid bigint, src_id string, type string, name string, qualifier string",
    ).withColumn("path", F.lit("a.py"))
    linked = spark.createDataFrame([("r:q", "q", "function", True)], "id string, name string, kind string, exported boolean")
    got = {(r["rid"], r["id"], r["rung"], r["confidence"]) for r in ladder.resolve(refs, nodes, placed, bases, linked).collect()}
    assert got == {
        (1, "far:t", "tables", "resolved"), (2, "a:K.m", "self", "resolved"), (3, "lib:B.up", "self", "resolved"), (4, "a:f", "same_file", "exact"), (5, "lib:g", "imported", "resolved"),
        (6, "lib:h", "receiver", "resolved"), (7, "lib:B.up", "receiver", "resolved"), (8, "a:K.m", "local_type", "resolved"), (9, "lib:h", "visible", "resolved"), (10, "far:z", "global", "heuristic"),
        (12, "a:K.m", "same_file", "exact"), (13, "r:q", "linked", "heuristic"),
    }


def test_module_columns(spark):
    from symgraph.functions import modules

    def one(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    assert one(modules.python_candidates(F.lit("..x.y"), F.lit("a/b/c.py"))) == ["a.x.y", "x.y", "y"]
    assert one(modules.python_candidates(F.lit("...x"), F.lit("a.py"))) == ["x"]
    assert one(modules.aliased(F.lit("@/q"), {"@/*": ["s/*"], "@/q": ["t"], "@/*z": ["n"]})) == ["s/q", "t"]
    assert one(text.clean_doc(F.lit("/** One.\n * two\n * @param x */"))).strip().split("\n")[:2] == ["One.", "two"]
    assert one(text.first_paragraph(text.clean_doc(F.lit("/** One.\n * two\n * @param x */")))) == "One. two"
    assert [one(text.unquote(F.lit(x))) for x in ('"a"', "rb'a'", "plain", '"""x"y"""', '"')] == ["a", "a", "plain", 'x"y', '"']


def test_rids(spark):
    rows = spark.createDataFrame([(p, k) for p in "cab" for k in (2, 1, 3)], "path string, k int")
    got = sorted((r["path"], r["k"], r["rid"]) for r in store.with_rids(rows, ["path"], ["k"], after=10).collect())
    assert sorted(r for *_, r in got) == list(range(11, 20))
    assert all(b[2] == a[2] + 1 for a, b in zip(got, got[1:]) if a[0] == b[0])
    changes = spark.createDataFrame([("/r/a",), ("/r/a",), ("/s/b",)], "path string")
    assert [r["path"] for r in store.touched(changes, "/r").collect()] == ["a"]


def test_store(spark):
    old = spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 1, 1), ("c", "1", 1, 1), ("d", "1", 1, 1)], "path string, hash string, size bigint, mtime_ms bigint")
    new = spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 1, 2), ("c", "2", 1, 2), ("e", "1", 1, 1)], old.schema)
    got = {r["path"]: r["change"] for r in store.snapshot_diff(old, new).collect()}
    assert got == {"a": "same", "b": "touched", "c": "modified", "d": "deleted", "e": "added"}
    unread = spark.createDataFrame([("a", None, 1, 1), ("b", None, 2, 2)], old.schema)
    assert {r["path"]: r["change"] for r in store.snapshot_diff(unread, unread).collect()} == {"a": "same", "b": "same"}
    mods = spark.createDataFrame([("a", "m", "f", True), ("a", "m", "f", False)], "path string, module string, family string, is_alias boolean")
    assert [r["is_alias"] for r in store.upsert_modules(mods).collect()] == [False]


def test_tools(spark):
    from symgraph.operators import tools
    from symgraph.sources import star

    nodes, links = star.nodes(spark, "/root/testdata/sf0.001"), star.edges(spark, "/root/testdata/sf0.001")
    roots = tools.roots_of(nodes, "NATION_3")
    assert [tuple(r) for r in roots.collect()] == [("NATION_3", "nation:3")]
    text_ = tools.render(tools.impact_of(nodes, links, roots, 2), 300)
    way = tools.shortest_path(nodes, links, "ASIA", "Supplier#000000001")
    assert way and all(" -> " in h or " <- " in h for h in way) and way[0].startswith("region:") and "supplier:1 (" in way[-1]
    assert tools.where_defined(nodes, "asai").count() == 0 and tools.shortest_path(nodes, links, "ASIA", "asai") is None
    assert "omitted: " in text_ and sum(-(-len(x) // 4) + 1 for x in text_.split("\n")) <= 300 + 10
    assert tools.search_symbols(nodes, "asia", limit=3).first()["name"] == "ASIA"
    assert tools.overview(nodes, links, "ASIA")["kinds"].count() >= 2
    assert tools.clamp(99, tools.DEPTHS, 1) == 6 and tools.clamp(None, tools.DEPTHS, 3) == 3


def test_change_stream(spark, tmp_path):
    """Bursts from a stream, once the watermark is past them, are those of the table."""
    from symgraph.streaming.changes import sessions

    rows = spark.createDataFrame([(1, 0), (1, 5), (1, 30), (2, 3), (2, 100_000)], "path bigint, s bigint").select("path", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    made = sessions(stream, "10 seconds", "1 second").writeStream.format("parquet").outputMode("append")
    made.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["path"], r["changes"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2), (1, 1), (2, 1)}
    assert {(r["path"], r["changes"]) for r in sessions(rows, "10 seconds").collect()} == got | {(2, 1)}


def test_ordinals_of_a_hot_group(spark):
    """A group with most rows, with ties, repeated rows and nulls, is numbered as one window would number it."""
    rows = spark.range(4000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).when(F.col("id") % 10 == 8, F.col("id").cast("string")).alias("g"), (F.col("id") % 700).alias("k"), F.lit(1).alias("n"))
    got = rank.ordinals(rows, ["g"], ["k"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["ordinal"], r["k"]))
    assert len(got) == 4000 and set(by) == {r["g"] for r in rows.select("g").distinct().collect()}
    for found in by.values():
        found.sort()
        assert [o for o, _ in found] == list(range(1, len(found) + 1)) and [k for _, k in found] == sorted(k for _, k in found)


def test_fuzzy_batch_of_names_that_share_their_pairs(spark):
    import random

    rng = random.Random(3)
    names = ["".join(rng.choice("aBc#") for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["a" * 70 + "bc", "", "abc"]
    rows = [(f"n{k}", n, rng.choice(["class", "constant"]), f"p{k % 3}", k % 5, k % 2 == 0) for k, n in enumerate(names)]
    nodes = spark.createDataFrame(rows, "id string, name string, kind string, path string, line_start int, exported boolean")
    asked = spark.createDataFrame([(q,) for q in ("a", "ab", "C#", "abca", "ccbb#", "a##ab", "#", "x", "cx", "abcabcabcabc", "aaaa")], "q string")
    expected = {(r["q"], k + 1, n["id"]) for r in asked.collect() for k, n in enumerate(lookup.fuzzy(nodes, r["q"]).collect())}
    for direct in (0, 20, 1000):  # only beginnings and parts; both ways; only pairs
        got = lookup.fuzzy_batch(asked, nodes, direct=direct)
        assert {(r["q"], r["rank"], r["id"]) for r in got.collect()} == expected


def test_fuzzy_batch_compares_few_names_of_a_common_pair(spark):
    nodes = spark.range(3000).selectExpr("concat('n', id) AS id", "concat('Customer#', lpad(id, 9, '0')) AS name", "'class' AS kind", "'p' AS path", "1 AS line_start", "true AS exported")
    asked = spark.range(300).selectExpr("concat('C#', id) AS q")
    made = []

    def seen(df, name, *by):
        out = kept(df, name, *by)
        made.append((name, out.count()))
        return out

    kept, lookup.kept = lookup.kept, seen
    try:
        assert lookup.fuzzy_batch(asked, nodes).groupBy("q").count().filter("count = 12").count() == 300
    finally:
        lookup.kept = kept
    assert sum(n for name, n in made if name in ("fuzzy-met", "fuzzy-front", "fuzzy-ends")) < 300 * 150


def test_visible_candidates_carry_the_fewer_rows(spark):
    from symgraph.operators import ladder

    defs = spark.createDataFrame(
        [("d1", "a", "x", "x", "class", True), ("d2", "b", "x", "x", "class", True)] + [(f"e{k}", "c", f"y{k}", f"y{k}", "class", True) for k in range(9)],
        "id string, path string, name string, qualified string, kind string, exported boolean",
    ).withColumn("lang", F.lit(None).cast("string"))
    sees = spark.createDataFrame([("p", "file:a"), ("p", "file:b"), ("p", "file:c"), ("q", "file:c"), ("q", "file:a")], "path string, key string")
    lies = spark.createDataFrame([(f, f"file:{f}") for f in "abc"], "path string, key string")
    asked = spark.createDataFrame([("p", n, "any") for n in ("x", "y1", "z1", "z2", "z3", "z4")] + [("q", "y2", "any")], "path string, name string, shape string")
    lists = ladder.shaped(defs).join(lies, "path").select("key", "name", "shape")
    listed, asking = ladder._ways(asked, sees, lists)
    assert {tuple(r) for r in listed.collect()} == {("p", "file:a"), ("p", "file:b")}
    assert {tuple(r) for r in asking.collect()} == {("p", "file:c"), ("q", "file:c"), ("q", "file:a")}
    got = ladder.visible_candidates(asked, sees, lies, defs)
    assert {tuple(r) for r in got.collect()} == {("p", "x", "any", "d1", 2), ("p", "x", "any", "d2", 2), ("p", "y1", "any", "e1", 1), ("q", "y2", "any", "e2", 1)}
    assert {r["path"] for r in ladder.visible_candidates(asked, sees, lies, defs, most=1).collect() if r["name"] == "x"} == set()
