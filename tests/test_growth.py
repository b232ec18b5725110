"""What joins and groups carry, on small tables made for it."""

from pyspark.sql import functions as F

from symgraph.operators import graph, lookup, rank, resolve
from symgraph.sources import star

DATA = "/root/testdata/sf0.001"


def test_names_meet_nodes_of_their_first_rung_only(spark, monkeypatch):
    """Many names that end in one segment, which all nodes have: each meets nodes by one key."""
    written = {}
    plain = lookup.kept

    def noted(df, name, *by):
        written[name] = plain(df, name, *by)
        return written[name]

    monkeypatch.setattr(lookup, "kept", noted)
    nodes = spark.range(50).select(F.concat(F.lit("r:p:k:"), F.col("id")).alias("id"), F.lit("f").alias("name"), F.concat(F.lit("T"), F.col("id"), F.lit(".f")).alias("qualified"), F.lit("p").alias("path"), F.lit("m").alias("module"))
    names = spark.range(40).select(F.concat(F.lit("T"), F.col("id"), F.lit(".f")).alias("q"))
    for few in (lookup.FEW, 0):
        monkeypatch.setattr(lookup, "FEW", few)
        found = lookup.ladder(names, nodes).collect()
        assert len(found) == 40 and {r["rung"] for r in found} == {"qualified"}
        assert written["lookup-first"].count() == 40


def test_line_items_are_grouped_by_tasks_of_bounded_size(spark, monkeypatch):
    count = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    monkeypatch.setattr(star, "TASK_ROWS", count // 20)
    pairs = star.edges(spark, DATA, ("constant",))
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 20 and max(sizes) < count // 5


def test_edges_to_some_kinds_are_those_edges(spark):
    kinds = star.nodes(spark, DATA).select(F.col("id").alias("dst_id"), "kind")
    want = star.edges(spark, DATA).join(kinds, "dst_id").filter("kind IN ('module', 'class')").select("src_id", "dst_id", "type", "confidence", "path", "line")
    got = star.edges(spark, DATA, ("module", "class"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "lineitem" not in " ".join(got.inputFiles())


def test_traverse_without_evidence_and_dead_ends(spark, monkeypatch):
    """Only ends of edges are needed, and of a large frontier only what leads on goes to the edges."""
    pairs = [("b", "a"), ("c", "a"), ("d", "b"), ("e", "d"), ("a", "e")] + [(f"leaf{k}", "a") for k in range(9)]
    ends = spark.createDataFrame(pairs, "src_id string, dst_id string")
    roots = spark.createDataFrame([("a", "a")], "root string, id string")
    want = {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3)} | {("a", f"leaf{k}", 1) for k in range(9)}
    for few in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", few)
        assert {tuple(r) for r in graph.traverse(ends, roots, 4, evidence=False).collect()} == want
    assert graph.traverse(ends, roots.filter("id = 'x'"), 4, evidence=False).columns == ["root", "id", "distance"]


def joined_rows(df):
    """The most rows that a join of ``df`` gives, by its metrics."""
    df.collect()
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        at = plans.pop()
        name = at.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plans.append(at.executedPlan())
        elif name.endswith("QueryStageExec"):
            plans.append(at.plan())
        else:
            if name.endswith("JoinExec"):
                most = max(most, at.metrics().apply("numOutputRows").value())
            plans += [at.children().apply(k) for k in range(at.children().size())]
    return most


def test_a_name_of_many_files_meets_imports_twice_at_most(spark):
    """An alias that all files have, and the importers are among them; canonical names come first, and a file isn't its own."""
    path = F.format_string("d%03d/f.py", F.col("id"))
    modules = spark.range(200).select(path.alias("path"), F.lit("python").alias("family"), F.lit("f").alias("module"), (F.col("id") != 7).alias("is_alias"))
    imports = spark.range(200).select(F.col("id").alias("rid"), path.alias("path"), F.lit("python").alias("family"), F.array(F.lit("x"), F.lit("f")).alias("candidates"))
    found = resolve.first_hit(imports, modules.unionByName(modules))
    assert {tuple(r) for r in found.collect()} == {(k, "d000/f.py" if k == 7 else "d007/f.py") for k in range(200)}
    assert joined_rows(found) <= 400


def test_paths_through_a_hub_leave_its_leaves_alone(spark, monkeypatch):
    """The end whose step makes fewer rows moves first, and a large step is written for pairs that it doesn't join only."""
    written = []
    plain = graph.kept

    def noted(df, name, *by):
        written.append((name, plain(df, name, *by)))
        return written[-1][1]

    monkeypatch.setattr(graph, "kept", noted)
    rows = [(f"s{k}", "n") for k in range(20)] + [("n", "r"), ("r", "q")] + [(f"o{k}", f"s{k % 20}") for k in range(2000)] + [("x", "o7"), ("y", "z")]
    links = spark.createDataFrame([(s, d, "calls", "exact", "p", 1) for s, d in rows], "src_id string, dst_id string, type string, confidence string, path string, line int")
    pairs = spark.createDataFrame([(f"s{k}", "r") for k in range(20)] + [("s7", "x"), ("s8", "y"), ("r", "r")], "a string, b string")
    want = {(f"s{k}", "r"): [(f"s{k}", "n"), ("n", "r")] for k in range(20)} | {("s7", "x"): [("o7", "s7"), ("x", "o7")], ("r", "r"): []}
    for few, steps, ids in ((graph.FEW, graph.STEPS, graph.IDS), (0, 1, graph.IDS), (0, 1, 0)):
        written.clear()
        for name, value in (("FEW", few), ("STEPS", steps), ("IDS", ids)):
            monkeypatch.setattr(graph, name, value)
        got = {(r["a"], r["b"]): [(h["src_id"], h["dst_id"]) for h in r["hops"]] for r in graph.shortest_paths(links, pairs, 4).collect()}
        assert got == want
        assert sum(t.count() for n, t in written if n == "path-level") < 600


def test_edges_at_a_kind_and_groups_ranked_in_one_part(spark):
    """Only relationships at suppliers are made for their neighbours, and small groups move once."""
    kinds = star.nodes(spark, DATA).filter("kind = 'struct'").select("id")
    every = star.edges(spark, DATA)
    want = every.join(kinds, F.col("id").isin(F.col("src_id"), F.col("dst_id"))).select(*every.columns)
    got = star.edges(spark, DATA, at=("struct",))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert graph.most_neighbours(got, kinds) == max(r["count"] for r in got.join(kinds, F.col("dst_id") == F.col("id")).groupBy("id").count().collect())
    assert rank.parts_of(600) == 1 and rank.parts_of(10**9) == 64
    rows = spark.range(3000).select((F.col("id") % 7).alias("g"), "id")
    once, twice = (rank.first_per_group(rows, ["g"], ["id"], 5, parts) for parts in (1, 64))
    assert once.exceptAll(twice).isEmpty() and once.count() == 35
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange") < twice._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_definitions_that_nothing_asks_for_are_not_listed(spark, monkeypatch):
    from symgraph.operators import ladder

    defs = spark.createDataFrame(
        [("d1", "a", "x", "x", "class", True)] + [(f"e{k}", "a", f"y{k}", f"y{k}", "class", True) for k in range(50)],
        "id string, path string, name string, qualified string, kind string, exported boolean",
    ).withColumn("lang", F.lit(None).cast("string"))
    sees = spark.createDataFrame([("p", "file:a")], "path string, key string")
    lies = spark.createDataFrame([("a", "file:a")], "path string, key string")
    asked = spark.createDataFrame([("p", "x", "bare"), ("p", "z", "any")], "path string, name string, shape string")
    made, kept = {}, ladder.kept

    def seen(df, name, *by):
        made[name] = kept(df, name, *by)
        return made[name]

    monkeypatch.setattr(ladder, "kept", seen)
    got = ladder.visible_candidates(asked, sees, lies, defs).collect()
    assert [tuple(r) for r in got] == [("p", "x", "bare", "d1", 1)]
    assert [(r["name"], r["shape"]) for r in made["scope-lists"].collect()] == [("x", "bare")]


def test_what_is_ahead_in_a_file_costs_its_lines_once(spark):
    from symgraph.extract import about, nesting

    files = spark.createDataFrame([("a.ts", "typescript", "class A {\n  open(\n    a) {\n  }\n}\n")], "path string, lang string, text string")
    lines = nesting.measured(files)
    found = {r["line"]: (r["head"]["line"], r["level"], r["closes"]) for r in lines.collect()}
    assert found == {1: (1, 0, None), 2: (3, 1, None), 3: (3, 1, None), 4: (4, 2, [1]), 5: (5, 1, [0])}
    defs = lines.filter("line < 3").withColumn("kind", F.lit("class"))
    spans = nesting.spans(defs, lines)
    assert {r["line"]: r["line_end"] for r in spans.collect()} == {1: 5, 2: 4}
    marks = about.decorators(lines.withColumnRenamed("said", "text"), lines.withColumnRenamed("said", "text"))
    for made in (lines, spans, marks):
        # such a frame looks at the rest of the file for each of its lines
        assert "unboundedfollowing" not in made._jdf.queryExecution().analyzed().toString()
