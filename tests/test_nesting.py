"""Blocks, owners, literals and statements of source texts."""

from symgraph.extract import lines, nesting
from symgraph.operators import index

LANGS = {"py": "python", "ts": "typescript", "go": "go", "java": "java", "swift": "swift", "sql": "sql"}

JAVA = """package p;
@Controller
public class A extends B {
  A(int x) { go(); }
  enum E { ONE(1), TWO(2); }
  private <T> List<T> go(
      int a)
      throws X
  {
    if (a) { go(); } else {
      go();
    }
    String s = "class Z {";
  }
  interface I {
    int size();
  }
}
class C {}
"""
SWIFT = """struct Item: Codable {
  let x = 1
  init(a: Int) {
    self.x = a
  }
  static func make() -> Item {
    return Item(a: 1)
  }
}
protocol P {
  func need()
}
func top() { make() }
"""
GO = """package c
type ID string
type R interface {
\tRead(p []byte) int
}
func (r *T) Do(
\ta int,
) {
\tfunc() { x() }()
}
/* func no() {
*/
func Last() {}
"""
PYTHON = """class A:

    x = {
 'a': 1,
}
    def f(self): return 1
    @deco
    async def g(self):
        return '''
def no():
'''

def h(): pass
class B: pass
"""
TYPESCRIPT = """export abstract class A<T> {
  get size(): number { return f(); }
  async *walk(a = { b: 1 }) {
    if (a) {
      f()
    }
  }
  abstract no(): void;
}
export default function () {}
function f() {
  const inner = (x) => x
}
"""
#: (qualified name, kind, first and last line) of the definitions of each text.
BLOCKS = {
    "a.java": (JAVA, [("A", "class", 3, 18), ("A.A", "method", 4, 4), ("A.E", "class", 5, 5), ("A.go", "method", 6, 14), ("A.I", "interface", 15, 17), ("A.I.size", "method", 16, 16), ("C", "class", 19, 19)]),
    "b.swift": (SWIFT, [("Item", "struct", 1, 9), ("Item.init", "method", 3, 5), ("Item.make", "method", 6, 8), ("P", "interface", 10, 12), ("P.need", "method", 11, 11), ("top", "function", 13, 13)]),
    "c.go": (GO, [("ID", "struct", 2, 2), ("R", "interface", 3, 5), ("R.Read", "method", 4, 4), ("T.Do", "method", 6, 10), ("Last", "function", 13, 13)]),
    "d.py": (PYTHON, [("A", "class", 1, 9), ("A.f", "method", 6, 6), ("A.g", "method", 8, 9), ("h", "function", 13, 13), ("B", "class", 14, 14)]),
    "e.ts": (TYPESCRIPT, [("A", "class", 1, 9), ("A.size", "method", 2, 2), ("A.walk", "method", 3, 7), ("A.no", "method", 8, 8), ("f", "function", 11, 13), ("f.inner", "function", 12, 12)]),
    "empty.py": ("", []),
    "open.ts": ("function f() {\n  g(`\n", [("f", "function", 1, 2)]),
}


def files(spark, texts):
    return spark.createDataFrame([(p, LANGS[p.rsplit(".", 1)[1]], t) for p, t in texts.items()], "path string, lang string, text string")


def test_blocks(spark):
    found = lines.definitions(files(spark, {p: t for p, (t, _) in BLOCKS.items()} | {"null.py": None})).collect()
    for path, (_, want) in BLOCKS.items():
        got = sorted((r["line"], r["qualified"], r["kind"], r["line_end"]) for r in found if r["path"] == path)
        assert [(q, k, a, b) for a, q, k, b in got] == want, path


def test_literals_are_joined(spark):
    texts = {"a.py": "x = f'a\\'b' # 'no'\ny = ('one ' # c\n     \"two\")\nz = 'p' + 'q', 'r'\n", "b.go": 'x := `a\nb` + "c"\n'}
    got = {(r["path"], r["line"], r["text"]) for r in nesting.literals(files(spark, texts)).collect()}
    assert got == {("a.py", 1, "a\\'b"), ("a.py", 2, "one two"), ("a.py", 4, "pq"), ("a.py", 4, "r"), ("b.go", 1, "a\nbc")}


CLI = '''"""run() isn't called here, nor is
main()."""
from app.base import (
    helper,
    Base,
)
def load():
    # helper()
    return db.query("select id from users u "
                    "join orders o on 1")
class L:
    def b(self):
        def inner():
            helper()
        return inner
    value = after()
def after(
    a="load()",
    b=1,
):
    pass
if __name__ == "__main__":
    load()
'''
DDL = """create table users (id int primary key, note text default 'create table ghost (x int);');
-- create table no (x int)
create table orders (
  id int,
  user_id int references users(id)
);
create view active as select * from users;
create unique index i on orders (id);
"""


def test_edges_of_nested_code_packages_and_statements(spark):
    texts = {
        "app/base.py": "class Base:\n    pass\n\ndef helper():\n    pass\n",
        "app/cli.py": CLI,
        "schema.sql": DDL,
        "srv/a.go": "package srv\nfunc (s *Store) Get() {\n\tFetch()\n}\nfunc Other() {}\n",
        "srv/b.go": "package srv\ntype Store struct {}\nfunc Fetch() {}\n",
        "cmd/run.go": 'package main\nimport "x/srv"\nfunc main() {\n\tsrv.Fetch()\n\tsrv.Other()\n\tvar s = "Fetch("\n}\n',
        "web/use.ts": "import {\n  make,\n  Box as B,\n} from './box';\nexport function all() {\n  make();\n  B.open();\n}\n",
        "web/box.ts": "export function make() {}\nexport class Box {\n  /* make() */\n  static open() {\n    return 'make()';\n  }\n}\n",
    }
    made = index.build(files(spark, texts))
    edges = {(r["src_id"], r["dst_id"], r["type"], r["confidence"]) for r in made.edges.collect() if r["type"] not in ("defines", "imports")}
    assert edges == {
        ("app/cli.py:function:load", "schema.sql:table:users", "queries", "resolved"),
        ("app/cli.py:function:load", "schema.sql:table:orders", "queries", "resolved"),
        ("app/cli.py:module", "app/cli.py:function:load", "calls", "exact"),
        ("app/cli.py:class:L", "app/cli.py:function:after", "calls", "exact"),
        ("app/cli.py:method:L.b.inner", "app/base.py:function:helper", "calls", "resolved"),
        ("schema.sql:table:orders", "schema.sql:table:users", "references", "exact"),
        ("schema.sql:table:active", "schema.sql:table:users", "queries", "resolved"),
        ("schema.sql:module", "schema.sql:table:orders", "references", "exact"),
        ("srv/a.go:method:Store.Get", "srv/b.go:function:Fetch", "calls", "resolved"),
        ("cmd/run.go:function:main", "srv/b.go:function:Fetch", "calls", "resolved"),
        ("cmd/run.go:function:main", "srv/a.go:function:Other", "calls", "resolved"),
        ("web/use.ts:function:all", "web/box.ts:function:make", "calls", "resolved"),
        ("web/use.ts:function:all", "web/box.ts:method:Box.open", "calls", "resolved"),
    }
    defines = {(r["src_id"], r["dst_id"]) for r in made.edges.filter("type = 'defines'").collect()}
    assert {("app/cli.py:method:L.b", "app/cli.py:method:L.b.inner"), ("app/cli.py:class:L", "app/cli.py:method:L.b"), ("schema.sql:module", "schema.sql:table:users")} <= defines


def test_texts_are_dealt_and_cut_once(spark):
    from symgraph.extract import lines
    from symgraph.tables import kept

    few = spark.range(64, numPartitions=1).selectExpr("concat('f', id, '.py') AS path", "'python' AS lang", "concat('x', id, ' = 1') AS text")
    # one task's rows become as many files as shuffles have partitions
    assert len(kept(few, "few").inputFiles()) == 1
    assert len(kept(few, "few", "path").inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = lines.prepared(few)
    assert lines.prepared(made) is made
    assert made.count() == 64 and lines.numbered(made).count() == 64
