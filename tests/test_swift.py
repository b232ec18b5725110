"""Swift: types over several files, modules as scopes, and receivers that say nothing."""

from symgraph.operators import index

TREE = {
    "Sources/App/Item.swift": """import Store
struct Item {
  func run() {
    helper()
    self.save()
    tag()
    Store.make()
    Store.Box.open()
    other.go()
    hidden()
  }
  struct Inner {
    func y() {
      run()
      tag()
    }
  }
}
class Sub: Base {
  func z() {
    super.zap()
    zip()
    self.zip()
  }
}
""",
    "Sources/App/ItemExt.swift": "public extension Item {\n  func save() {}\n  func tag() {}\n}\nextension Item.Inner {\n  func deep() { y() }\n}\n",
    "Sources/App/Base.swift": "class Base {\n  func zap() {}\n  func zip() {}\n}\nclass Other {\n  func go() {}\n  func hidden() {}\n}\nfunc helper() {}\n",
    "Sources/Store/S.swift": "func make() {}\nstruct Box {\n  static func open() {}\n}\nfunc helper(a: Int) {}\n",
    "app.py": "def zip(): pass\ndef hidden(): pass\n",
}


def test_swift_members_and_modules(spark):
    rows = [(p, "swift" if p.endswith("swift") else "python", t) for p, t in TREE.items()]
    made = index.build(spark.createDataFrame(rows, "path string, lang string, text string"))
    edges = {(r["src_id"].split(":", 1)[1], r["dst_id"], r["type"], r["confidence"]) for r in made.edges.collect() if r["type"] in ("calls", "inherits")}
    item, ext, base, store = "Sources/App/Item.swift", "Sources/App/ItemExt.swift", "Sources/App/Base.swift", "Sources/Store/S.swift"
    assert edges == {
        ("method:Item.run", f"{ext}:method:Item.save", "calls", "resolved"),
        ("method:Item.run", f"{ext}:method:Item.tag", "calls", "resolved"),
        ("method:Item.run", f"{store}:function:make", "calls", "resolved"),
        ("method:Item.run", f"{store}:method:Box.open", "calls", "resolved"),
        ("method:Item.run", f"{base}:function:helper", "calls", "heuristic"),  # two modules that the file sees have one
        ("method:Item.run", f"{store}:function:helper", "calls", "heuristic"),
        ("method:Item.Inner.y", f"{item}:method:Item.run", "calls", "exact"),
        ("method:Item.Inner.deep", f"{item}:method:Item.Inner.y", "calls", "resolved"),
        ("class:Sub", f"{base}:class:Base", "inherits", "resolved"),
        ("method:Sub.z", f"{base}:method:Base.zap", "calls", "resolved"),
        ("method:Sub.z", f"{base}:method:Base.zip", "calls", "resolved"),
    }
