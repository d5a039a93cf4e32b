import json

import pytest

from quillspark import schema
from quillspark.__main__ import main, setting

TEXT = "<p>The recommended dose of this medicine is {n} mg orally once daily for adults with renal impairment and others.</p>"


@pytest.fixture
def answers(tmp_path):
    for kind in ("concepts", "classes", "labels"):
        (tmp_path / "in" / kind).mkdir(parents=True)
    for n, name in enumerate(("alphadrug", "betadrug", "nolabel"), 1):
        (tmp_path / f"in/concepts/{name}.json").write_text(json.dumps({"idGroup": {"rxnormId": [str(n)]}}))
        (tmp_path / f"in/classes/{n}.json").write_text(json.dumps({"rxclassDrugInfoList": {"rxclassDrugInfo": [{"rxclassMinConceptItem": {"classId": c}} for c in ("C10", "C10AA")]}}))
        if name != "nolabel":
            result = {"set_id": f"abcd-{n}", "effective_time": "20250102", "openfda": {"generic_name": [name], "brand_name": ["brand"], "application_number": ["NDA1"]}, "dosage_and_administration": [TEXT.format(n=5 * n)], "warnings": ["<p>Do not use it when the liver is known to be severely impaired, and stop it when jaundice appears.</p>"]}
            (tmp_path / f"in/labels/{name}.json").write_text(json.dumps({"results": [result]}))
    return tmp_path


def test_ingest_and_ask(spark, answers):
    common = ["--table", f"{answers}/table", "--log", f"{answers}/log"]
    take = lambda *more: main([*common, "ingest", "--answers", f"{answers}/in", "--drug", "AlphaDrug", "--drug", "betadrug", "--drug", "nolabel", "--drug", "nothing", *more], spark)
    first = take()
    assert first["labels"] == 2 and first["failed"] == ["nolabel", "nothing"] and first["documents"] >= 6
    again = take()
    assert again["labels"] == 0 and again["skipped"] == 2 and again["documents"] == 0
    rows = sorted(r.urn_id for r in spark.read.schema(schema.INDEX).parquet(f"{answers}/table").collect())
    assert take("--reset-checkpoint", "--limit", "1")["labels"] == 1
    assert sorted(r.urn_id for r in spark.read.schema(schema.INDEX).parquet(f"{answers}/table").collect()) == rows
    got = main([*common, "ask", "What is the dose of alphadrug in renal impairment?", "--year", "2026"], spark)
    assert got["layouts"][0] == "dosing" and sum(got["sections"].values()) > 0 and 1 <= len(got["rounds"]) <= 3
    assert got["rounds"][0]["hits"] <= 60


def test_setting(monkeypatch):
    monkeypatch.setenv("QUILL_X", "up")
    assert setting("quill_x") == "up"
    monkeypatch.setenv("quill_x", "low")
    assert setting("quill_x") == "low" and setting("quill_y", "d") == "d"


def test_hot_values_and_release(spark):
    from quillspark import runtime

    df = spark.range(30_000).selectExpr("if(id % 3 = 0, -1, id) as k", "cast(null as string) as s")
    assert runtime.hot_values(df, "k") == [-1] and runtime.hot_values(df, "s") == [] and runtime.hot_values(df.limit(0), "k") == []
    staged = runtime.stage(df, "x")
    runtime.release(staged)
    assert not spark.sparkContext._jvm.java.io.File(staged._staged_at.removeprefix("file://")).exists()
