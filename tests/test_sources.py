"""Walking, ignoring and extracting, over a small tree made here."""

import pytest
from pyspark.sql import functions as F

from symgraph.extract import lines
from symgraph.sources import walk

TREE = {
    "app/main.py": "import os\nfrom .db import Store\n\nLIMIT = 3\n# class Hidden\nclass App(Base):\n    async def run(self):\n        return Store().get(LIMIT)\n\ndef main():\n    App().run()\n",
    "app/view.ts": "import { x } from './x';\nexport class View {}\nexport const render = (a: number) => a;\nexport interface Shape {}\nfunction go() { render(1); }\n",
    "srv/main.go": 'package main\nimport (\n\t"fmt"\n)\ntype Store struct {}\nfunc (s *Store) Get() {}\nfunc Run() { fmt.Println(1) }\n',
    "A.java": "import java.util.List;\npublic class A {\n    public static final int MAX = 1;\n    public void go() { run(); }\n}\n",
    "b.swift": "import Store\nstruct Item {}\nfunc top() {}\n",
    "schema.sql": 'CREATE TABLE IF NOT EXISTS public."Users" (id int);\n-- create table no (x int)\ncreate view active as select 1;\n',
    "node_modules/x.py": "def no(): pass\n",
    "readme.txt": "text",
    "bin.py": "a\0b",
    ".gitignore": "# rules\n*.gen.py\n!keep.gen.py\n/only_root.py\n",
    "app/.gitignore": "/local.py\nsub/\n!x.gen.py\n",
    "x.gen.py": "a = 1\n",
    "keep.gen.py": "a = 1\n",
    "app/x.gen.py": "a = 1\n",
    "only_root.py": "a = 1\n",
    "app/only_root.py": "a = 1\n",
    "local.py": "a = 1\n",
    "app/local.py": "a = 1\n",
    "app/sub/y.py": "a = 1\n",
    "main.py.symgraph-tmp-12": "a = 1\n",
    "cfg.symgraph-tmp-1.py": "a = 1\n",
}
LEFT_OUT = {
    "node_modules/x.py", "readme.txt", "bin.py", ".gitignore", "app/.gitignore", "x.gen.py", "app/x.gen.py", "only_root.py", "app/local.py", "app/sub/y.py",
    "main.py.symgraph-tmp-12", "cfg.symgraph-tmp-1.py",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return walk.files(spark, str(root))


def test_walk(tree):
    got = {r["path"]: r for r in tree.collect()}
    assert set(got) == set(TREE) - LEFT_OUT
    assert got["A.java"]["lang"] == "java" and got["A.java"]["size"] == len(TREE["A.java"]) and len(got["A.java"]["hash"]) == 32


def test_scope_links_and_stale_answers(spark, tmp_path):
    from symgraph.streaming import changes

    for path in ("a/x.py", "ab/y.py", "a/b/z.py"):
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text("x = 1\n")
    found = walk.files(spark, str(tmp_path / "src"), scope="a")
    assert [r["path"] for r in walk.in_order(found).collect()] == ["a/b/z.py", "a/x.py"]
    spark.range(3).write.parquet(str(tmp_path / "one" / "nodes"))
    with pytest.warns(UserWarning, match="two"):
        both = walk.linked(spark, {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")}, "nodes")
    assert {r["repo"] for r in both.collect()} == {"one"}
    last = spark.range(1)
    assert changes.answer(lambda: 1 / 0, last) == (last, "answered from the last state: division by zero")


def test_extract(tree):
    defs = {(r["path"], r["kind"], r["name"], r["line"]) for r in lines.definitions(tree).collect()}
    assert {("app/main.py", "constant", "LIMIT", 4), ("app/main.py", "class", "App", 6), ("app/main.py", "method", "run", 7), ("app/main.py", "function", "main", 10)} <= defs
    assert {("app/view.ts", "class", "View", 2), ("app/view.ts", "function", "render", 3), ("app/view.ts", "interface", "Shape", 4), ("app/view.ts", "function", "go", 5)} <= defs
    assert {("srv/main.go", "struct", "Store", 5), ("srv/main.go", "method", "Get", 6), ("srv/main.go", "function", "Run", 7)} <= defs
    assert {("A.java", "class", "A", 2), ("A.java", "constant", "MAX", 3), ("A.java", "method", "go", 4), ("b.swift", "struct", "Item", 2), ("b.swift", "function", "top", 3)} <= defs
    assert {("schema.sql", "table", "users", 1), ("schema.sql", "table", "active", 3)} <= defs
    assert len(defs) == 18
    mods = {(r["path"], r["module"]) for r in lines.imports(tree).collect()}
    assert mods == {("app/main.py", "os"), ("app/main.py", ".db"), ("app/view.ts", "./x"), ("srv/main.go", "fmt"), ("A.java", "java.util.List"), ("b.swift", "Store")}
    called = {(r["path"], r["qualifier"], r["name"]) for r in lines.calls(tree).collect()}
    assert {("app/main.py", None, "Store"), ("app/main.py", None, "App"), ("srv/main.go", "fmt", "Println"), ("A.java", None, "run")} <= called
    assert ("app/main.py", None, "main") not in called


def test_ignore_rules(spark):
    paths = ["a.log", "keep.log", "x/b.log", "build/a", "x/build/b", "doc/a.md", "doc/x/b.md", "src/gen/x.py"]
    rules = ["# comment", "*.log", "!keep.log", "build/", "/doc/*.md", "src/**/x.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"] for r in df.filter(walk.ignored(F.col("path"), rules)).collect()} == {"a.log", "x/b.log", "build/a", "x/build/b", "doc/a.md", "src/gen/x.py"}
    assert [r["path"] for r in df.filter(walk.in_scope(F.col("path"), "doc/x")).collect()] == ["doc/x/b.md"]


def test_tables_in_text(spark):
    got = spark.range(1).select(lines.tables_in_text(F.lit("SELECT * FROM app.Users u JOIN orders o WHERE x IN (select 1 from users); UPDATE t SET a")).alias("t")).first()["t"]
    assert got == ["users", "orders"]


def test_index(spark):
    """From texts to relationships: imports, a barrel, supertypes, inherited members, receivers and a package."""
    from symgraph.operators import index

    tree = {
        "app/base.py": "class Base:\n    def save(self):\n        pass\n\ndef helper():\n    pass\n",
        "app/__init__.py": "from .base import Base\nfrom .base import *\n",
        "app/main.py": "import os\nfrom app import Base as B\nfrom . import base\n\nclass Item(B):\n    def run(self):\n        self.save()\n        base.helper()\n        os.getcwd()\n\ndef main():\n    Item().run()\n    helper()\n",
        "web/x.ts": "export default function start() {}\nexport const go = () => start();\nexport class Box extends Lid {\n}\n",
        "web/lid.ts": "export class Lid {}\n",
        "web/index.ts": "import start, { go as g } from './x.js';\nimport * as lids from './lid';\nexport function all() {\n  g();\n}\n",
        "srv/a.go": 'package srv\nimport "fmt"\nfunc (s *Store) Get() {\n\tFetch()\n}\n',
        "srv/b.go": "package srv\ntype Store struct {}\nfunc Fetch() {}\n",
    }
    rows = [(p, {"py": "python", "ts": "typescript", "go": "go"}[p.rsplit(".", 1)[1]], t) for p, t in tree.items()]
    made = index.build(spark.createDataFrame(rows, "path string, lang string, text string"))
    ids = {r["id"] for r in made.nodes.collect()}
    assert {"app/base.py:class:Base", "app/base.py:method:Base.save", "app/main.py:method:Item.run", "srv/a.go:method:Store.Get", "web/x.ts:function:start", "web/index.ts:module"} <= ids
    edges = {(r["src_id"], r["dst_id"], r["type"], r["confidence"]) for r in made.edges.collect()}
    assert {
        ("app/__init__.py:module", "app/base.py:class:Base", "imports", "resolved"),
        ("app/main.py:module", "app/base.py:class:Base", "imports", "resolved"),
        ("app/main.py:module", "app/__init__.py:module", "imports", "resolved"),
        ("app/main.py:module", "app/base.py:module", "imports", "resolved"),
        ("app/main.py:class:Item", "app/base.py:class:Base", "inherits", "resolved"),
        ("app/main.py:method:Item.run", "app/base.py:method:Base.save", "calls", "resolved"),
        ("app/main.py:method:Item.run", "app/base.py:function:helper", "calls", "resolved"),
        ("app/main.py:function:main", "app/main.py:class:Item", "calls", "exact"),
        ("app/main.py:function:main", "app/base.py:function:helper", "calls", "resolved"),
        ("web/index.ts:module", "web/x.ts:function:go", "imports", "resolved"),  # the preferred export stands for the default
        ("web/index.ts:function:all", "web/x.ts:function:go", "calls", "resolved"),
        ("web/x.ts:class:Box", "web/lid.ts:class:Lid", "inherits", "heuristic"),
        ("app/base.py:class:Base", "app/base.py:method:Base.save", "defines", "exact"),
        ("srv/a.go:method:Store.Get", "srv/b.go:function:Fetch", "calls", "resolved"),
    } <= edges
    assert not any("os" in e[1].split(":")[0] for e in edges)


def test_roots_of_any_spelling(spark, tmp_path):
    root = tmp_path / "my root+1"
    for path in ("link/y.py", "my dir/a b.py", "my dir/100%.py"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x = 1\n")
    (root / "my dir" / ".gitignore").write_text("/100%.py\n")
    for spelled in (str(root), f"file://{root}", f"file:{root}/"):
        assert {r["path"] for r in walk.files(spark, spelled).collect()} == {"link/y.py", "my dir/a b.py"}
        assert {r["path"] for r in walk.files(spark, spelled, scope="my dir").collect()} == {"my dir/a b.py"}


def test_an_answer_that_fails_when_it_runs(spark):
    from symgraph.streaming import changes

    last = spark.range(1)
    found, warning = changes.answer(lambda: spark.range(3).select(F.raise_error(F.lit("late failure"))), last)
    assert found is last and "answered from the last state" in warning
    found, warning = changes.answer(lambda: spark.range(3), last)
    assert found.count() == 3 and warning is None


def test_edges_of_a_query_follow_the_files(spark, tmp_path):
    import shutil

    from symgraph.plans import graph_queries

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf")
    before = graph_queries.impact_of_nation(spark, str(tmp_path / "sf")).count()
    half = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").filter("c_custkey > 75")
    half.write.parquet(str(tmp_path / "new"))
    (tmp_path / "sf" / "customer.parquet").unlink()
    shutil.move(tmp_path / "new", tmp_path / "sf" / "customer.parquet")
    after = graph_queries.impact_of_nation(spark, str(tmp_path / "sf"))
    assert after.count() < before and after.filter("kind = 'class'").count() == half.filter("c_nationkey = 3").count()
