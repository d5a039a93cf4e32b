import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import vectors as V
from quillspark.operators import retrieval


def test_maxsim(spark):
    q, d = [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.6, 0.8]]
    row = spark.createDataFrame([(q, d, [])], "q array<array<float>>, d array<array<float>>, e array<array<float>>").select(V.maxsim(F.col("q"), F.col("d")).alias("s"), V.maxsim(F.col("q"), F.col("e")).alias("none")).first()
    assert row.s == pytest.approx(0.9, abs=1e-6)
    assert row.none == 0.0


def test_encoding_of_no_vectors_is_zero():
    assert not V.pooled_encoding(np.zeros((0, V.TOKEN_DIM), np.float32)).any()


def test_representation(spark):
    df = spark.createDataFrame([(1, "renal dose of x"), (2, ""), (3, None)], "id int, t string").select("id", V.represent()(F.col("t")).alias("r")).select("id", "r.*").orderBy("id").collect()
    assert len(df[0].content_vector) == 768 and len(df[0].token_vecs) == 4 and len(df[0].fde) == 1024
    assert np.linalg.norm(df[0].fde) == pytest.approx(1, abs=1e-5)
    assert df[1].token_vecs == [] and not any(df[2].fde)


def test_zero_vector_stays(spark):
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(V.normalised(F.col("v")).alias("v")).first().v == [0.0, 0.0]


def test_knn_breaks_ties_by_id_and_skips_bad_vectors(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, None), (4, [float("nan"), 0.0]), (5, [1.0])], "id int, v array<float>")
    assert [r.id for r in retrieval.knn(df, [1.0, 0.0], 5, "id", "v").collect()] == [1, 2]


def test_knn_batch_in_blocks(spark):
    vectors = [(i, [float(i % 7), float(i % 5)]) for i in range(30)]
    df = spark.createDataFrame([*vectors, (30, None), (31, [float("nan"), 0.0])], "id int, v array<float>")
    asked = df.where("id < 12").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    expected = {(q, r + 1): i for q, x in vectors[:12] for r, (_, i) in enumerate(sorted((-np.dot(x, y), i) for i, y in vectors)[:3])}
    for block in (4, 1000):
        assert {(r.query_id, r["rank"]): r.id for r in retrieval.knn_batch(df, asked, 3, "id", "v", block).collect()} == expected


def test_cutoff(spark):
    assert str(spark.range(1).select(retrieval.cutoff_of(F.lit("2026-11-26").cast("date")).alias("d")).first().d) == "2023-01-02"


def test_union_first(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 0, 5), ("b", 1, 1)], "urn string, pool int, rank int")
    got = {r.urn: r.pool for r in retrieval.union_first([df, df], "urn", ["pool", "rank"]).collect()}
    assert got == {"a": 0, "b": 1}


def test_rerank_without_query_vectors_keeps_order(spark):
    hits = spark.createDataFrame([("x", "p", 1, [[1.0]]), ("y", "p", 2, None)], "urn_id string, pool string, rank int, v array<array<float>>")
    assert [r.urn_id for r in retrieval.rerank(hits, [], "v", 5, ["pool"]).orderBy("pool_rank").collect()] == ["x", "y"]
