"""Docs, signatures, decorators, endpoints and visibility of definitions."""

from symgraph.operators import index

LANGS = {"py": "python", "ts": "typescript", "java": "java", "swift": "swift", "go": "go", "sql": "sql"}
PYTHON = '''"""What the file is for.

More.
"""
import flask
app = flask.Flask()

# not a docstring's
@app.route("/users/<id>", methods=["get", "PUT"])
@login
def users(
    id: int,
) -> str:
    """Gives a user.

    More.
    """
    return id

@app.post(
    "/users")
async def make(): return 1

class A(B):
    x = "no doc"
'''
JAVA = """package p;
/**
 * Serves orders.
 * @author x
 */
@RestController
@RequestMapping("/api/")
public class Orders {
  // Finds one.
  @GetMapping(value = "/{id}", produces = "json")
  public String one(int id) { return "a"; }

  // apart

  @RequestMapping(path = {"x", "y"}, method = {RequestMethod.POST, RequestMethod.PUT})
  String two(
      int a) { return "b"; }
  private void three() {}
}
interface I {
  void four();
}
"""
TYPESCRIPT = """// Starts it.
// Twice.
export function start(app: App) {
  app.get('/health', ok);
  router.use("/all", x);
  app.get(name, '/no');
}
app.delete('/top', y);
const hidden = () => 1;
"""


def test_described_nodes_and_endpoints(spark):
    texts = {"a.py": PYTHON, "Orders.java": JAVA, "b.ts": TYPESCRIPT, "c.go": "package c\n// Run runs.\n// Yes.\nfunc (s *S) Run(a int) error {\n}\n", "d.swift": "/// Holds.\npublic struct S: P {\n  private(set) public var x = 1\n  func f() {}\n}\n"}
    files = spark.createDataFrame([(p, LANGS[p.rsplit(".", 1)[1]], t) for p, t in texts.items()], "path string, lang string, text string")
    made = index.build(files)
    nodes = {r["id"]: r for r in made.nodes.collect()}
    about = {i.split(":", 1)[1] if i.startswith(("a.py", "Orders")) else i: (r["signature"], r["doc"], r["exported"]) for i, r in nodes.items()}
    assert nodes["a.py:module"]["doc"] == "What the file is for."
    assert about["function:users"] == ("def users( id: int, ) -> str", "Gives a user.", True)
    assert about["function:make"] == ("async def make()", None, True)
    assert about["class:A"] == ("class A(B)", None, True)
    assert about["class:Orders"] == ("public class Orders", "Serves orders.", True)
    assert about["method:Orders.one"] == ("public String one(int id)", "Finds one.", True)
    assert about["method:Orders.two"][1:] == (None, False) and about["method:Orders.three"][2] is False and about["method:I.four"][2] is True
    assert about["b.ts:function:start"] == ("export function start(app: App)", "Starts it. Twice.", True) and about["b.ts:function:hidden"][2] is False
    assert about["c.go:method:S.Run"] == ("func (s *S) Run(a int) error", "Run runs. Yes.", True)
    assert about["d.swift:struct:S"][1:] == ("Holds.", True) and about["d.swift:method:S.f"][2] is False
    ends = {(r["path"], r["name"], r["line_start"]) for r in nodes.values() if r["kind"] == "endpoint"}
    assert ends == {
        ("a.py", "GET|PUT /users/<id>", 9), ("a.py", "POST /users", 20), ("Orders.java", "GET /api/{id}", 10), ("Orders.java", "POST|PUT /api/x", 15),
        ("b.ts", "GET /health", 4), ("b.ts", "ANY /all", 5), ("b.ts", "DELETE /top", 8),
    }
    assert nodes["a.py:endpoint:GET|PUT /users/<id>"]["doc"] == "Gives a user."
    edges = {(r["src_id"], r["dst_id"]) for r in made.edges.collect() if r["src_id"].split(":")[1] == "endpoint"}
    assert edges == {
        ("a.py:endpoint:GET|PUT /users/<id>", "a.py:function:users"), ("a.py:endpoint:POST /users", "a.py:function:make"),
        ("Orders.java:endpoint:GET /api/{id}", "Orders.java:method:Orders.one"), ("Orders.java:endpoint:POST|PUT /api/x", "Orders.java:method:Orders.two"),
        ("b.ts:endpoint:GET /health", "b.ts:function:start"), ("b.ts:endpoint:ANY /all", "b.ts:function:start"), ("b.ts:endpoint:DELETE /top", "b.ts:module"),
    }
    marks = {(r["src_id"], r["name"], r["qualifier"]) for r in made.refs.filter("type = 'references'").collect()}
    assert {("a.py:function:users", "route", "app"), ("a.py:function:users", "login", None), ("Orders.java:class:Orders", "RestController", None)} <= marks
