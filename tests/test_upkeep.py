"""Any order of changes ends in the tables of a build from nothing."""

import hashlib

from pyspark.sql import functions as F

from symgraph.operators import index
from symgraph.streaming import changes, upkeep

LANGS = {"py": "python", "go": "go", "sql": "sql"}
BASE = "class Base:\n    def save(self):\n        pass\n\ndef helper():\n    pass\n"
MAIN = "from app.base import Base as B, helper as h\nimport app.base\n\nclass Item(B):\n    def run(self):\n        self.save()\n        h()\n        lonely()\n        return db('select id from users where 1')\n\nItem().run()\n"
STEPS = [
    {"app/base.py": BASE, "app/main.py": MAIN, "srv/a.go": "package srv\nfunc A() {\n\tB()\n\tC()\n}\n", "srv/b.go": "package srv\nfunc B() {}\n", "db.sql": "create table users (id int);\n", "gone.py": "def lonely():\n    pass\n"},
    # a name moves to another file of its package, a base loses a member, a file goes, a table comes in another file
    {"app/base.py": "class Root:\n    def save(self):\n        pass\nclass Base(Root):\n    pass\ndef helper():\n    return 1\n", "gone.py": None, "srv/c.go": "package srv\nfunc C() {}\n", "db.sql": "create table users (id int);\n-- seen\n", "db2.sql": "create table users (id int references users(id));\n"},
    # what an import meant is defined elsewhere, and a lonely name comes back twice
    {"app/base.py": "from app.deep import Base, helper\n", "app/deep.py": BASE, "x.py": "def lonely():\n    pass\n", "y.py": "def lonely():\n    pass\ndef other():\n    lonely()\n", "srv/b.go": "package srv\nfunc B2() {}\n"},
]


def state(texts):
    return [(p, LANGS[p.rsplit(".", 1)[1]], t) for p, t in texts.items() if t is not None]


def tables(made):
    edges = {tuple(r) for r in made.edges.select("src_id", "dst_id", "type", "confidence", "path", "line").collect()}
    nodes = {tuple(r) for r in made.nodes.select("id", "name", "qualified", "kind", "line_start", "line_end").collect()}
    return nodes, edges


def test_a_stream_of_changes_ends_in_a_cold_build(spark, tmp_path):
    now, texts = 0, {}
    for k, step in enumerate(STEPS):
        rows = []
        for path, text in step.items():
            now += 1
            if text is not None and path != "db.sql":  # a state that is overtaken within its batch
                rows.append((path, now - 100, 1, now - 100, "old", LANGS[path.rsplit(".", 1)[1]], "def overtaken(): pass\n"))
            hash_ = None if text is None else hashlib.sha256(text.encode()).hexdigest()
            rows.append((path, now, len(text or ""), now, hash_, LANGS[path.rsplit(".", 1)[1]], text))
        if k == 1:
            rows.append(("app/main.py", now + 1, len(MAIN), now + 1, hashlib.sha256(MAIN.encode()).hexdigest(), "python", None))  # touched: its text isn't read
        frame = spark.createDataFrame(rows, "path string, ts long, size bigint, mtime_ms bigint, hash string, lang string, text string")
        frame.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "records"))
        texts.update(step)
        stream = changes.incoming(spark, str(tmp_path / "records"), upkeep.RECORDS, batch=1)
        upkeep.follow(stream, str(tmp_path / "index"), str(tmp_path / "checkpoint")).awaitTermination()
        number, _ = upkeep.current(spark, str(tmp_path / "index"))
        assert number == k
        if k:  # the first is a build itself
            got = tables(upkeep.index_of(spark, str(tmp_path / "index")))
            assert got == tables(index.build(spark.createDataFrame(state(texts), "path string, lang string, text string")))
    # delivered again, a batch changes nothing
    upkeep.apply_batch(spark, spark.createDataFrame([], upkeep.RECORDS), number, str(tmp_path / "index"))
    assert upkeep.current(spark, str(tmp_path / "index"))[0] == number
    edges = got[1]
    assert ("app/main.py:method:Item.run", "app/deep.py:method:Base.save", "calls", "resolved", "app/main.py", 6) in edges
    assert {e[1] for e in edges if e[0] == "app/main.py:method:Item.run" and e[5] == 8} == {"x.py:function:lonely", "y.py:function:lonely"}


def test_plan_of_a_batch(spark):
    states = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "h"), ("c", 1, 1, "h"), ("d", 1, 1, "h")], upkeep.STATES)
    rows = [("a", 5, 1, 1, "h"), ("b", 5, 2, 1, "h"), ("c", 5, 1, 2, "x"), ("d", 5, 0, 0, None), ("e", 5, 0, 0, None), ("f", 4, 0, 0, None), ("f", 5, 1, 1, "n")]
    batch = spark.createDataFrame([(*r, "python", "t") for r in rows], "path string, ts long, size bigint, mtime_ms bigint, hash string, lang string, text string")
    got = {r["path"]: r["action"] for r in upkeep.plan(batch.withColumn("ts", F.timestamp_seconds("ts")), states).collect()}
    assert got == {"a": "same", "b": "touch", "c": "parse", "d": "delete", "e": "same", "f": "parse"}
