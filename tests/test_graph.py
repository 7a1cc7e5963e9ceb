from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators import quality as Q

EDGE = "src_id string, dst_id string, type string, line int"


def edges(spark, *pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, 1) for a, b in pairs], EDGE)


def entities(spark, ids):
    return spark.createDataFrame([(i, "function", i, i, "python", f"{i}.py", 1, 2) for i in ids], "entity_id string, type string, name string, qualified_name string, language string, file string, start_line int, end_line int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_callers_by_level_with_a_cycle_and_a_pseudo_node(spark):
    e = edges(spark, ("b", "a"), ("c", "b"), ("a", "c"), ("route:GET /", "b"), ("x", "route:GET /"))
    assert rows(G.callers(e, "a", 2)) == [("a", "b", 1), ("b", "c", 2), ("b", "route:GET /", 2)]
    assert ("route:GET /", "x", 3) in rows(G.callers(e, "a", 3))
    assert G.callers(e, "a", 0).isEmpty() and G.callers(e, "nowhere", 3).isEmpty()


def test_dependencies_stop_at_what_is_no_entity(spark):
    e = edges(spark, ("a", "b"), ("b", "external:z"), ("external:z", "q"), ("b", "wildcard:py:m"))
    got = {(r.parent, r.child, r.kind, r.dist) for r in G.dependencies(e, entities(spark, "ab"), "a", 5).collect()}
    assert got == {("a", "b", "entity", 1), ("b", "external:z", "external", 2), ("b", "wildcard:py:m", "wildcard", 2)}


def test_shortest_path_prefers_fewer_hops_then_smaller_ids(spark):
    e = edges(spark, ("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"))
    assert G.shortest_path(e, "a", "e").first().path == ["a", "b", "d", "e"]
    assert G.shortest_path(e, "a", "a").first().path == ["a"]
    assert G.shortest_path(e, "e", "a").isEmpty() and G.shortest_path(e, "a", "e", 2).isEmpty()


def test_cycles_in_one_task_and_by_colouring_agree(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("f", "f")]
    g = spark.createDataFrame(pairs, "src_file string, dst_file string")
    want = {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert set(map(tuple, G.strong_components(g).collect())) == want
    assert set(map(tuple, G.strong_components(g, one_task=0).collect())) == want
    assert [r.members for r in G.cycles(g).collect()] == [["a", "b", "c"], ["d", "e"]]


def test_long_chain_has_no_cycle(spark):
    chain = spark.range(3000).select(F.col("id").cast("string").alias("s"), (F.col("id") + 1).cast("string").alias("d"))
    pd_rows = G._tarjan(chain.toPandas())
    assert pd_rows == []


def test_degree_counts_a_loop_once(spark):
    got = dict(map(tuple, G.degrees(edges(spark, ("a", "a"), ("a", "b"))).collect()))
    assert got == {"a": 2, "b": 1}


def test_registered_decorators(spark):
    src = ["@app.command()\ndef f(): pass", "@cached\n\n@x.route('/')\ndef f(): pass", "@cached\ndef f(): pass", "import x\n@task\ndef f(): pass", None, ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(src)], "i int, s string")
    assert [r.r for r in df.select("i", Q.registered(F.col("s")).alias("r")).orderBy("i").collect()] == [True, True, False, False, False, False]


def test_layer_of_first_matching_directory(spark):
    df = spark.createDataFrame([("cold/backend/routers/a.py",), ("x/y.py",), ("z.py",), ("Models/b.py",)], "p string")
    got = [(r.l.dir, r.l.layer) for r in df.select(Q.layer_dir(F.col("p")).alias("l")).collect()]
    assert got == [("cold/backend/routers", "presentation"), ("x", "other"), (".", "other"), ("Models", "data")]


def test_traversals_store_frontiers_and_not_all_edges(spark, monkeypatch):
    real, sizes = G.cut, []
    monkeypatch.setattr(G, "cut", lambda df: (sizes.append(df.count()), real(df))[1])
    e = edges(spark, ("a", "b"), ("b", "c"), *[(f"x{i}", f"y{i}") for i in range(50)])
    assert G.shortest_path(e, "a", "c").first().path == ["a", "b", "c"]
    assert rows(G.callers(e, "c", 3)) == [("b", "a", 2), ("c", "b", 1)]
    assert max(sizes) == 1
