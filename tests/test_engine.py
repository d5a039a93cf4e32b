"""The engine over an index that has no vectors and no postings: the same answers, and little on disk."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from quillspark import catalog, runtime
from quillspark.functions import vectors as V
from quillspark.operators import ingest, lexical
from quillspark.plans.engine import Engine


def test_an_answer_writes_less_than_four_times_its_input(spark, data):
    before = len(runtime._STAGED)
    assert catalog.queries()["reflective_answer"](spark, data).count() == 10
    written = [f for _, folder in runtime._STAGED[before:] for f in Path(folder.removeprefix("file://")).rglob("*.parquet")]
    assert written and sum(f.stat().st_size for f in written) < 4 * Path(f"{data}/raw_chunks.parquet").stat().st_size


def test_vectors_made_when_scored_are_those_stored(spark):
    texts = [f"dose {i} of x in renal impairment " * (i % 9) for i in range(600)]
    df = spark.createDataFrame([*enumerate(texts), (600, ""), (601, None)], "id int, t string").repartition(1)
    asked = np.random.default_rng(1).standard_normal(V.FDE_DIM).tolist()
    wanted = df.select("id", V.represent()(F.col("t")).alias("r")).select("id", "r.token_vecs", V.dot(F.col("r.fde"), F.lit(asked)).alias("fde"), V.dot(F.col("r.content_vector"), F.lit(asked[: V.DIM])).alias("content"))
    got = df.select("id", V.token_vectors()(F.col("t")).alias("token_vecs"), V.similarity(asked, "fde")(F.col("t")).alias("fde"), V.similarity(asked[: V.DIM], "content_vector")(F.col("t")).alias("content"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_scan_gives_the_scores_of_an_index(spark):
    columns = "id int, a string, b string, c string"
    rows = [(1, "heart attack and renal renal failure", "aspirin", None), (2, "an MI", "", None), (3, None, "renal drug", None), (4, "nothing here", "none", ""), (5, "a myocardial infarction, by mouth", "mi", None), (6, "", None, None)]
    df = spark.createDataFrame(rows, columns)
    weights = {"a": 1.0, "b": 3.0, "c": 2.0}
    for synonyms in (False, True):
        scan, index = lexical.Scan(df, "id", list(weights), synonyms), lexical.Index.build(df, "id", list(weights), synonyms=synonyms)
        for question in ("renal failure after a heart attack", "absent", "", "MI mi"):
            for own in (weights, {"b": 3.0}):
                got, wanted = ({r.id: round(r.score, 9) for r in x.search(question, own, 1.2).collect()} for x in (scan, index))
                assert got == wanted
    assert {r.id for r in scan.search("renal", weights).collect()} == {1, 3} and len(scan._counts) == 5


def test_evidence_without_stored_vectors_is_the_same(spark, data):
    chunks = runtime.table(spark, data, "raw_chunks").where("urn_id is not null and layout_type is not null")
    latest = ingest.latest_per_key(chunks, ["urn_id"], [F.desc_nulls_last("ingested_at"), F.desc("row_id")])
    stored = runtime.stage(latest.withColumn("r", V.represent()(F.col("verbatim_text"))).select("*", "r.*").drop("r"), "index")
    answers = []
    for index, once in ((stored, False), (runtime.stage(latest, "index"), True)):
        engine = Engine(spark, index, 2026, min_score=0.99, once=once)
        evidence, reports, last = engine.ask("What is the max dose in ckd?", 2)
        near = engine.lookup("neighbours", evidence, last)
        answers.append((reports, last, *(sorted((r.urn_id, r["rank"], r.maxsim) for r in x.collect()) for x in (evidence, near))))
    assert answers[0] == answers[1] and answers[0][2] and answers[0][3]
