import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from quillspark.functions.html import html_to_text
from quillspark.operators import ingest
from quillspark.sources import labels, sinks
from quillspark.streaming.ingest import ingest_stream


def refuse(code):
    return urllib.error.HTTPError("u", code, "no", {}, None)


@pytest.mark.parametrize(("answers", "body", "waits"), [(["ok"], "ok", []), ([429, 429, "ok"], "ok", [5, 10]), ([500, 503, 502], None, [5, 5, 5]), ([404], None, []), ([OSError(), "ok"], "ok", [5])])
def test_fetch(answers, body, waits):
    slept, left = [], list(answers)

    def opener(url, timeout):
        a = left.pop(0)
        if isinstance(a, int):
            raise refuse(a)
        if isinstance(a, Exception):
            raise a
        return a

    assert labels.fetch("u", opener, sleep=slept.append) == body
    assert slept == waits


def test_http_source(spark):
    import urllib.error  # the class below travels to the workers by value

    class Canned(labels.JsonHttp):
        @classmethod
        def name(cls):
            return "canned"

        @staticmethod
        def opener(url, timeout):
            if url.endswith("missing"):
                raise urllib.error.HTTPError(url, 404, "no", {}, None)
            return json.dumps({"idGroup": {"rxnormId": [url[-1] + "1", "x"]}})

    got = labels.read_http(spark, "http://x/{name}", ["a", "missing", "b"], Canned, delay=0)
    assert sorted(map(tuple, labels.concepts(got).collect())) == [("a", "a1"), ("b", "b1")]


def body(set_id, day, number, **sections):
    return json.dumps({"results": [{"set_id": set_id, "effective_time": day, "openfda": {"application_number": [number]}, **sections}]})


def test_preferred_labels_and_interactions(spark):
    rows = [("a", body("s1", "20240101", "NDA1", drug_interactions=["<p>x</p>", "<p> </p>"])), ("a", body("s2", "20250101", "ANDA2")), ("a", body("s3", "20260101", "BLA3")), ("b", "not json"), ("c", None), ("d", '{"results": []}')]
    found = labels.labels(spark.createDataFrame(rows, "name string, body string"))
    assert [(r.name, r.result.set_id) for r in labels.preferred(found).collect()] == [("a", "s2")]
    assert labels.by_set_id(found, "s3").count() == 1
    assert [r.text for r in labels.interactions(found, html_to_text).collect()] == ["x"]


def test_repackaged_labels_are_not_preferred(spark):
    flagged = lambda set_id, day, flag: json.dumps({"results": [{"set_id": set_id, "effective_time": day, "openfda": {"application_number": ["NDA1"], "is_original_packager": flag}}]})
    rows = [("a", flagged("s1", "20240101", [True])), ("a", flagged("s2", "20250101", [False]))]
    assert [r.result.set_id for r in labels.preferred(labels.labels(spark.createDataFrame(rows, "name string, body string"))).collect()] == ["s1"]


def test_lanes_hold_all_names():
    options = {"names": json.dumps(list("abcde")), "url": "u/{name}", "delay": "0"}
    for lanes, sizes in (("1", [5]), ("2", [3, 2]), ("9", [1] * 5)):
        reader = labels.JsonReader(options | {"lanes": lanes}, lambda url, timeout: url)
        assert [len(p.names) for p in reader.partitions()] == sizes
        assert sorted(x for p in reader.partitions() for x in reader.read(p)) == [(c, f"u/{c}") for c in "abcde"]


def test_phases(spark, tmp_path):
    log = f"{tmp_path}/log"
    assert not sinks.is_phase_done(spark, log, "ingest")
    sinks.mark_phase(spark, log, "ingest")
    assert sinks.is_phase_done(spark, log, "ingest") and not sinks.is_phase_done(spark, log, "other")
    sinks.reset(spark, log)
    assert not sinks.is_phase_done(spark, log, "ingest")


def test_log_file(spark, tmp_path):
    assert labels.ingest_log(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "log.json").write_text('{"set_id": "a", "n_docs": 3}\n{broken\n')
    assert [r.set_id for r in labels.ingest_log(spark, f"{tmp_path}/log.json").collect()] == ["a"]
    done = spark.createDataFrame([("a", "g"), ("a", "g"), ("b", None)], "set_id string, drug_name_generic string")
    sinks.mark_done(done, f"{tmp_path}/done")
    assert {r.set_id: r.n_docs for r in labels.ingest_log(spark, f"{tmp_path}/done").collect()} == {"a": 2, "b": 1}
    assert ingest.not_done(done, labels.ingest_log(spark, f"{tmp_path}/done")).count() == 0
    sinks.reset(spark, f"{tmp_path}/done")
    assert labels.ingest_log(spark, f"{tmp_path}/done").count() == 0


def test_upsert_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    schema = "k string, v int, layout_type string"
    sinks.create_table(spark, path, schema)
    put = lambda rows: sinks.upsert_table(spark, path, spark.createDataFrame(rows, schema), "k", [F.desc("v")], columns=schema)
    put([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "y")])
    put([("a", 2, "z"), ("b", 3, "y"), ("b", 2, "y")])
    put([("a", 2, "z"), ("b", 3, "y"), ("b", 2, "y")])
    assert sorted(map(tuple, spark.read.schema(schema).parquet(path).collect())) == [("a", 2, "z"), ("b", 3, "y"), ("c", 1, "y")]
    sinks.create_table(spark, path, schema)
    assert spark.read.schema(schema).parquet(path).count() == 3
    sinks.create_table(spark, path, schema, force=True)
    assert spark.read.schema(schema).parquet(path).count() == 0


def test_stream_takes_every_file_once(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("src", "out", "ck"))
    for n in range(2):
        spark.range(n * 5, n * 5 + 5).write.mode("append").parquet(src)
        ingest_stream(spark, src, out, ck)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))


def test_answers_and_log_lines(tmp_path):
    assert sinks.generate("p", lambda p: {"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}) == "a\nb"
    with pytest.raises(ValueError):
        sinks.answer_text({"candidates": []})
    log = sinks.JsonLog(f"{tmp_path}/x/log.jsonl")
    with sinks.Timer(log, "step", n=1) as t:
        pass
    line = json.loads(open(f"{tmp_path}/x/log.jsonl").read())
    assert line["message"] == "step" and line["elapsed_ms"] == t.ms and line["n"] == 1
