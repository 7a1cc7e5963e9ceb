"""Registered queries over tables made here, against their SQL or plain reckoning."""

import random

import duckdb
import pandas as pd

from sparkloom import catalog
from sparkloom.operators import resolve as R
from sparkloom.plans import adapter as A


def same_as_sql(spark, path, name):
    c = duckdb.connect()
    for p in path.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.execute(catalog.oracle_sql()[name]).fetchall()
    got = catalog.queries()[name](spark, str(path))
    assert got.columns == [x[0] for x in c.description]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    return want


def test_vector_ids_of_five_digits_are_cut_as_in_sql(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 0), (9, [0.0, 1.0], 0), (12345, [1.0, 0.5], 1), (12346, [1.0, 0.25], 1)]
    pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).to_parquet(tmp_path / "embeddings.parquet")
    assert "v1234" in dict(same_as_sql(spark, tmp_path, "vector_topk"))


def broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.strip() for x in plan.splitlines() if "BroadcastHashJoin" in x]


def test_resolution_of_imports_broadcasts_no_table(spark):
    assert not broadcasts(catalog.queries()["resolve_py_import"](spark, "/root/testdata/sf0.001"))


def test_resolution_figures_broadcast_no_table(spark):
    assert not broadcasts(catalog.queries()["resolution_stats"](spark, "/root/testdata/sf0.001"))


def test_containing_looks_into_blocks_of_lines(spark):
    r = random.Random(5)
    own = [(f"py:{f}:{i}", "method" if i % 3 else "function", f, a := r.randint(-3, 90), a + r.choice([-1, 0, 1, 3, 7, 8, 30, 64])) for f in "ab" for i in range(60)]
    rows = [*own, ("py:a:m", "module", "a", 1, 999)]
    entities = spark.createDataFrame(rows, "entity_id string, type string, file string, start_line int, end_line int")
    calls = [(f"{f}{n}", f, n) for f in "abc" for n in range(-5, 170)] + [("none", "a", None)]
    want = {}
    for edge, f, n in calls:
        hit = [(b - a, i) for i, _, g, a, b in own if n is not None and f == g and a <= n <= b]
        want[edge] = min(hit)[1] if hit else "py:a:m" if f == "a" else None
    out = R.containing(spark.createDataFrame(calls, "edge string, file string, line int"), entities)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "Join [" in x and "start_line" in x]  # entities of a file don't meet all lines of the file
    assert {x.edge: x.entity_id for x in out.collect()} == want


def copied(spark, path, shift):
    """The sf0.001 tables; customers and suppliers twice, with shifted keys and the same names."""
    for name in ("nation", "region", "part", "orders", "lineitem", "customer", "supplier", "pages", "documents"):
        df = pd.read_parquet(f"/root/testdata/sf0.001/{name}.parquet")
        keys = [k for k in ("c_custkey", "s_suppkey", "o_custkey", "o_orderkey", "l_orderkey", "l_suppkey") if k in df]
        if keys:
            df = pd.concat([df, df.assign(**{k: df[k] + shift for k in keys})], ignore_index=True)
        df.to_parquet(path / f"{name}.parquet", coerce_timestamps="us")


def test_equal_ids_of_several_keys_give_an_edge_once(spark, tmp_path):
    copied(spark, tmp_path, 1_000_000)
    for name in ("index_status", "rag_degree", "containing_entity"):
        assert same_as_sql(spark, tmp_path, name)


def test_edges_of_lineitem_are_dealt_once_by_part(spark):
    e = A.edges(spark, "/root/testdata/sf0.001")
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not [x for x in broadcasts(e) if "nationkey" not in x]
    assert e.count() == e.distinct().count() == A._spark(spark, A.EDGES, "/root/testdata/sf0.001").count()
