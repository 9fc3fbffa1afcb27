"""Vectors of any finite size take part in op2."""

import pytest

import __spark_entry__  # noqa: F401
from compare import compare, duck
from quizlens.llm import queries


def made(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(
        str(tmp_path / "made"))
    part = next((tmp_path / "made").glob("part-*.parquet"))
    (tmp_path / "embeddings.parquet").write_bytes(part.read_bytes())
    return str(tmp_path)


def test_large_components_as_in_sql(spark, tmp_path):
    rows = [(i, [float(i % 7) - 3, 0.5, float(i % 3)]) for i in range(100)]
    rows += [(200, [70000.0, 1.0, 0.0]), (201, [0.0, 1e9, 3.0]), (202, [-2.0**24, 2.0**22, 1e5])]
    sf = made(spark, tmp_path, rows)
    found = queries.op2_topk(spark, sf)
    assert compare(found, duck(sf), queries.OP2_SQL) == ""
    assert {200, 201} <= {r.query_id for r in found.collect()} | {r.vec_id for r in found.collect()}


def test_a_score_beyond_longs_raises(spark, tmp_path):
    sf = made(spark, tmp_path, [(0, [1e12, 0.0]), (1, [1e12, 1.0]), (2, [1.0, 1.0])])
    with pytest.raises(Exception, match="does not fit a long"):
        queries.op2_topk(spark, sf).collect()
