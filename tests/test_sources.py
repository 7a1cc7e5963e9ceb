from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import resolve as R
from sparkloom.sources import parse as P
from sparkloom.sources import store as S
from sparkloom.sources import walk as W
from sparkloom.streaming import changes as C


def test_python_parser():
    src = "import os\nfrom .db import Session\n\n@app.get('/users/')\nasync def users(s: Session):\n    '''List.'''\n    return s.query()\n\nclass A(Base):\n    def go(self):\n        self.go()\n        helper()\n"
    p = P.parse("api/users.py", src, "python")
    by = {e["entity_id"]: e for e in p.entities}
    assert set(by) == {"py:api/users.py:api.users", "py:api/users.py:users", "py:api/users.py:A", "py:api/users.py:A.go"}
    assert by["py:api/users.py:users"]["is_async"] and by["py:api/users.py:users"]["docstring"] == "List." and by["py:api/users.py:users"]["start_line"] == 4
    assert by["py:api/users.py:A.go"]["parent_id"] == "py:api/users.py:A"
    dst = {(e["type"], e["dst_id"]) for e in p.edges}
    assert {("imports", "py:?:os"), ("imports", "py:?rel1:db.Session"), ("calls", "?methodcall:Session.query"), ("inherits", "?inherits:0:Base"), ("calls", "?methodcall:A.go"), ("calls", "?call:helper")} <= dst
    assert any(e["src_id"] == "route:GET /users" and e["dst_id"] == "py:api/users.py:users" for e in p.edges)


def test_python_classes_within_classes():
    p = P.parse("n.py", "class Outer:\n    class Inner(Base):\n        class Last:\n            def m(self):\n                self.n()\n        def k(self):\n            pass\n    def o(self):\n        def local():\n            pass\n", "python")
    by = {e["qualified_name"]: e for e in p.entities}
    assert set(by) == {"n", "Outer", "Outer.Inner", "Outer.Inner.Last", "Outer.Inner.Last.m", "Outer.Inner.k", "Outer.o"}
    assert by["Outer.Inner.Last.m"]["type"] == "method" and by["Outer.Inner.Last.m"]["parent_id"] == "py:n.py:Outer.Inner.Last"
    assert by["Outer.Inner"]["parent_id"] == "py:n.py:Outer" and by["Outer"]["parent_id"] is None
    assert {("py:n.py:Outer.Inner", "?inherits:0:Base"), ("py:n.py:Outer.Inner.Last.m", "?methodcall:Last.n")} <= {(e["src_id"], e["dst_id"]) for e in p.edges}


def test_receivers_of_calls():
    cases = [  # language, source, function, what it calls
        ("typescript", "class W {\n  render() {}\n  draw() {\n    this.render();\n  }\n}\n", "W.draw", "?methodcall:W.render"),
        ("typescript", "class S {\n  notify() {}\n}\nclass C {\n  use(svc: S) {\n    svc.notify();\n  }\n}\n", "C.use", "?methodcall:S.notify"),
        ("typescript", "class S {\n  save() {}\n}\nclass C {\n  private svc: S;\n  run() {\n    this.svc.save();\n  }\n}\n", "C.run", "?methodcall:S.save"),
        ("typescript", "class C {\n  use(svc: List<S>) {\n    svc.notify();\n  }\n}\n", "C.use", "?call:notify"),
        ("java", "class S {\n  void save() {}\n}\nclass C {\n  private S svc;\n  void run() {\n    this.svc.save();\n  }\n}\n", "C.run", "?methodcall:S.save"),
        ("java", "class C {\n  void use(S svc) {\n    svc.go();\n  }\n}\n", "C.use", "?methodcall:S.go"),
        ("java", "class C {\n  void use() {\n    var svc = new S();\n    svc.go();\n  }\n}\n", "C.use", "?methodcall:S.go"),
        ("go", "package m\ntype W struct{}\nfunc (w *W) Render() {}\nfunc (w *W) Draw() {\n    w.Render()\n}\n", "W.Draw", "?methodcall:W.Render"),
        ("go", "package m\nfunc use() {\n    lg := &L{}\n    lg.Log()\n}\n", "use", "?methodcall:L.Log"),
        ("go", "package m\nfunc use(svc *S) {\n    svc.Go()\n}\n", "use", "?methodcall:S.Go"),
        ("go", "package m\ntype C struct {\n    svc *S\n}\nfunc (c *C) Run() {\n    c.svc.Save()\n}\n", "C.Run", "?methodcall:S.Save"),
        ("rust", "struct W;\nimpl W {\n    fn render(&self) {}\n    fn draw(&self) {\n        self.render();\n    }\n}\n", "W.draw", "?methodcall:W.render"),
        ("rust", "fn use_it() {\n    let lg = L::new();\n    lg.log();\n}\n", "use_it", "?methodcall:L.log"),
        ("rust", "fn use_it(svc: &S) {\n    svc.notify();\n}\n", "use_it", "?methodcall:S.notify"),
        ("rust", "struct C {\n    svc: S,\n}\nimpl C {\n    fn run(&self) {\n        self.svc.save();\n    }\n}\n", "C.run", "?methodcall:S.save"),
        ("php", "<?php\nclass C {\n    private S $svc;\n    function run() {\n        $this->svc->save();\n    }\n}\n", "C.run", "?methodcall:S.save"),
        ("php", "<?php\nclass C {\n    function use(S $svc) {\n        $svc->notify();\n    }\n}\n", "C.use", "?methodcall:S.notify"),
        ("php", "<?php\nfunction use_it() {\n    $lg = new L();\n    $lg->log();\n}\n", "use_it", "?methodcall:L.log"),
        ("ruby", "class W\n  def render\n  end\n  def draw\n    self.render\n  end\nend\n", "W.draw", "?methodcall:W.render"),
        ("ruby", "class C\n  def initialize\n    @svc = S.new\n  end\n  def run\n    @svc.save\n  end\nend\n", "C.run", "?methodcall:S.save"),
        ("ruby", "def use_it\n  y = Server.create('x')\n  y.run\nend\n", "use_it", "?call:run"),
        ("cpp", "class W {\npublic:\n    void Render() {}\n    void Draw() {\n        this->Render();\n    }\n};\n", "W.Draw", "?methodcall:W.Render"),
        ("cpp", "void use_it() {\n    L* lg = new L();\n    lg->Log();\n}\n", "use_it", "?methodcall:L.Log"),
        ("cpp", "class C {\npublic:\n    void Use(S* svc) {\n        svc->Notify();\n    }\n};\n", "C.Use", "?methodcall:S.Notify"),
        ("cpp", "class C {\npublic:\n    void Run() {\n        this->svc->Save();\n    }\nprivate:\n    S* svc;\n};\n", "C.Run", "?methodcall:S.Save"),
        ("cpp", "void use_it() {\n    int x = get_thing();\n    x.process();\n}\n", "use_it", "?call:process"),
    ]
    for language, src, fn, want in cases:
        p = P.parse("d/f.x", src, language)
        got = {(e["src_id"].split(":")[-1], e["dst_id"]) for e in p.edges if e["type"] == "calls"}
        assert not p.errors and (fn, want) in got, (language, src, p.errors, got)
        other = f"?call:{want.rpartition('.')[2]}" if "methodcall" in want else "?methodcall:"
        assert not any(s == fn and d.startswith(other) for s, d in got), (language, src, got)


def test_parsers_never_raise_and_name_what_they_see():
    cases = {
        "go": ("package m\nimport \"fmt\"\ntype S struct { x int }\nfunc (s *S) Run() { fmt.Println() }\nfunc main() {}\n", {"S": "class", "S.Run": "method", "main": "function"}),
        "java": ("import a.B;\npublic class S extends T {\n  public void run() { go(); }\n}\n", {"S": "class", "S.run": "method"}),
        "typescript": ("import { a } from './b';\nexport class S { run() { a(); } }\nexport const f = (x) => x;\nfunction g() {}\n", {"S": "class", "f": "function", "g": "function"}),
        "rust": ("use std::io;\nstruct S;\nimpl S {\n  pub fn run(&self) {}\n}\nfn main() {}\n", {"S": "class", "S.run": "method", "main": "function"}),
        "ruby": ("require 'x'\nclass S < T\n  def run\n  end\nend\n", {"S": "class", "S.run": "method"}),
        "sql": ("CREATE TABLE t (a int);\nCREATE VIEW v AS SELECT 1;\n", {"t": "class", "v": "class"}),
        "css": (".a > b { x: y }\n@keyframes k { from { a: b } }\n", {".a > b": "function", "@keyframes k": "function"}),
        "html": ("<html><script src='a.js'></script><div id='m'><p id='n'>x</p></div></html>", {"m": "function", "n": "function"}),
        "bash": ("go() {\n  ls\n}\n", {"go": "function"}),
        "elixir": ("defmodule A do\n  def run do\n  end\nend\n", {"A": "module", "A.run": "method"}),
    }
    for language, (src, want) in cases.items():
        p = P.parse("d/f.x", src, language)
        got = {e["qualified_name"]: e["type"] for e in p.entities if e["entity_id"] != p.module}
        assert not p.errors and want.items() <= got.items(), (language, p.errors, got)
    for language in P.PARSERS:
        for src in ("", "\0{{{", "def f(:\n", "class " * 50):
            P.parse("a.b", src, language)
    assert P.parse("a.py", "def f(:", "python").errors


def test_parsed_as_tables_and_resolved(spark):
    files = [("pkg/a.py", "python", "from pkg.b import helper\n\ndef main():\n    helper()\n    main()\n"), ("pkg/b.py", "python", "def helper():\n    pass\n")]
    df = spark.createDataFrame(files, "path string, language string, source string")
    e, r = P.entities_and_edges(df)
    out = {(x.src_id, x.dst_id, x.type) for x in R.resolve(r, e, df.select("path")).collect()}
    assert ("py:pkg/a.py:main", "py:pkg/b.py:helper", "calls") in out and ("py:pkg/a.py:main", "py:pkg/a.py:main", "calls") in out
    assert not any("?" in d for _, d, _ in out)


def test_walk_reads_sources_only(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b.bin": b"x", "node_modules/c.py": b"", "d/e.GO": b"package d", "f.py": b"a\0b", "logs/g.py": b"", "bad.py": b"\xff\xfeok"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r for r in W.walk(spark, str(tmp_path), "logs/\n").collect()}
    assert set(got) == {"a.py", "d/e.GO", "bad.py"} and got["a.py"].loc == 2 and got["d/e.GO"].language == "go"


def test_ignore_rules(spark):
    rules = W.ignore_rules("*.log\n!keep.log\nbuild/\n/top.txt\na/**/z\n")
    paths = ["x.log", "d/x.log", "keep.log", "build/a", "c/build/a", "top.txt", "c/top.txt", "a/z", "a/b/c/z", "builds/a"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.i for r in df.select(W.ignored(F.col("p"), rules).alias("i")).collect()] == [True, True, False, True, True, True, False, True, True, False]


def test_store_index_twice_changes_nothing(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    pass\n")
    store = S.Store(spark, str(tmp_path / "db"))
    resolve = lambda e, r: r
    first = store.index(W.walk(spark, str(src)), P.entities_and_edges, resolve)
    again = store.index(W.walk(spark, str(src)), P.entities_and_edges, resolve)
    assert first["changed"] == 1 and again["changed"] == 0 and again["entities"] == 2 == first["entities"]
    (src / "a.py").unlink()
    (src / "b.py").write_text("x = 1\n")
    assert store.index(W.walk(spark, str(src)), P.entities_and_edges, resolve)["entities"] == 1
    assert S.discover(tmp_path) is None


def test_names_and_tokens(spark):
    row = spark.createDataFrame([("parseHTTPResponse2_v10",)], "n string").select(T.segments(F.col("n")).alias("s")).first()
    assert row.s == ["parse", "http", "response", "2", "v", "10"]
    df = spark.createDataFrame([("",), (None,), ("abc",), ("a" * 9,)], "t string")
    assert [r.n for r in df.select(T.estimated_tokens(F.col("t")).alias("n")).collect()] == [0, 0, 1, 2]


def test_change_stream_as_a_stream(spark, tmp_path):
    events = [("a.py", "created", None, "2024-01-01 00:00:00"), ("a.py", "deleted", None, "2024-01-01 00:00:00.1"), ("b.py", "moved", "c.py", "2024-01-01 00:00:05"), ("x.bin", "created", None, "2024-01-01 00:00:06"), ("z.py", "created", None, "2024-01-01 01:00:00")]
    spark.createDataFrame(events, "path string, action string, dest string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("path string, action string, dest string, ts timestamp").parquet(str(tmp_path / "in"))
    q = C.applied(C.debounced(C.relevant(stream).select("path", "action", "ts"), delay="1 second"), lambda b, n: seen.extend((r.path, r.action) for r in b.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {("a.py", "deleted"), ("b.py", "deleted"), ("c.py", "modified")} <= set(seen)


def test_quarantine_after_three_failures(spark):
    rows = [("p", i, ok, a) for i, (ok, a) in enumerate([(False, "m"), (False, "m"), (False, "m"), (True, "m"), (False, "m"), (False, "deleted")])]
    got = C.quarantine(spark.createDataFrame(rows, "path string, seq long, ok boolean, action string")).orderBy("seq").collect()
    assert [(r.failures, r.quarantined) for r in got] == [(1, False), (2, False), (3, True), (0, False), (1, False), (0, False)]
