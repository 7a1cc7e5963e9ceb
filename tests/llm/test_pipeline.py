import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as cp  # noqa: E402
from sparkloom.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_hand_on_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(cp.STAGES) - 1:
            assert docs.columns == names, name
            assert docs.count() <= before
            before = docs.count()
    sums = docs.groupBy("sequence_id").sum("length").collect()
    assert sums and max(r[1] for r in sums) <= 4096


def test_stages_take_an_empty_table(spark):
    none = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, SMALL).isEmpty()


def test_every_operator_is_registered():
    names = queries.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
