"""Sources of labels and concepts: a Spark data source for JSON over HTTP, and the same answers from files.

The data source spreads its names over ``lanes`` partitions (one, unless told otherwise) and waits between the
requests of each, so the rate of the whole job is ``lanes / delay`` whatever the cluster. It repeats a request that
was answered 429 (waiting longer each time) or 500, 502, 503; every other failure is a null body,
never a failed task. Its ``opener`` can be replaced, so it runs without a network in tests.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark import schema

RETRIED_SLOWLY, RETRIED = 429, (500, 502, 503)


def fetch(url: str, opener: Callable[[str, float], str], retries: int = 3, wait: float = 5.0, timeout: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The body of ``url``, or null when it can't be had."""
    for attempt in range(max(1, retries)):
        try:
            return opener(url, timeout)
        except urllib.error.HTTPError as e:
            if e.code == RETRIED_SLOWLY:
                sleep(wait * (attempt + 1))
            elif e.code in RETRIED:
                sleep(wait)
            else:
                return None
        except Exception:  # noqa: BLE001 - the network fails in many ways; each is tried again
            sleep(wait)
    return None


def open_url(url: str, timeout: float) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        return answer.read().decode("utf-8")


class Lane(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class JsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str], opener: Callable[[str, float], str]) -> None:
        self.options, self.opener = options, opener

    def partitions(self) -> list[InputPartition]:
        names, lanes = json.loads(self.options.get("names", "[]")), max(1, int(self.options.get("lanes", "1")))
        return [Lane(names[i::lanes]) for i in range(min(lanes, len(names)))]

    def read(self, partition: Lane) -> Iterator[tuple[str, str | None]]:
        o = self.options
        for name in partition.names:
            time.sleep(float(o.get("delay", "0.34")))
            url = o["url"].replace("{name}", urllib.parse.quote(name))
            yield name, fetch(url, self.opener, int(o.get("retries", "3")), float(o.get("wait", "5")), float(o.get("timeout", "30")))


class JsonHttp(DataSource):
    """``spark.read.format("json_http").option("url", "https://.../{name}").option("names", '["a"]').load()``."""

    opener: Callable[[str, float], str] = staticmethod(open_url)

    @classmethod
    def name(cls) -> str:
        return "json_http"

    def schema(self) -> str:
        return "name string, body string"

    def reader(self, schema) -> JsonReader:  # noqa: ANN001
        return JsonReader(dict(self.options), type(self).opener)


def read_http(spark: SparkSession, url: str, names: list[str], source: type[JsonHttp] = JsonHttp, **options: object) -> DataFrame:
    """``name, body``; one request per name."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(url=url, names=json.dumps(names), **{k: str(v) for k, v in options.items()}).load()


def labels(bodies: DataFrame) -> DataFrame:
    """``name, result`` of ``name, body`` label answers; names without a result drop out."""
    parsed = bodies.select("name", F.get(F.from_json("body", schema.LABEL_RESPONSE)["results"], F.lit(0)).alias("result"))
    return parsed.where("result is not null")


def preferred(found: DataFrame) -> DataFrame:
    """The latest original label per name, of several ``name, result`` rows.

    Original is a label with an application number ``NDA`` or ``ANDA`` that is not said to come from a repackager.
    """
    numbers = F.coalesce(F.col("result.openfda.application_number"), F.array().cast("array<string>"))
    original = found.where(F.exists(numbers, lambda x: x.startswith("NDA") | x.startswith("ANDA")))
    if "is_original_packager" in found.schema["result"].dataType["openfda"].dataType.names:
        original = original.where(F.coalesce(F.exists("result.openfda.is_original_packager", lambda x: x), F.lit(True)))
    return original.groupBy("name").agg(F.max_by("result", F.struct(F.col("result.effective_time"), F.col("result.set_id"))).alias("result"))


def by_set_id(found: DataFrame, set_id: str) -> DataFrame:
    return found.where(F.col("result.set_id") == set_id)


def interactions(found: DataFrame, text: Callable[[Column], Column]) -> DataFrame:
    """``name, text, severity, rxcui``: one row per interaction paragraph that is not empty after ``text`` strips it."""
    rows = found.select("name", F.explode(F.col("result.drug_interactions")).alias("html"))
    return rows.select("name", text(F.col("html")).alias("text"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("rxcui")).where(F.length("text") > 0)


def concepts(bodies: DataFrame) -> DataFrame:
    """``name, rxcui``: the first concept of each name; names without one drop out."""
    return bodies.select("name", F.get(F.from_json("body", schema.CONCEPT_RESPONSE)["idGroup"]["rxnormId"], F.lit(0)).alias("rxcui")).where("rxcui is not null")


def classes(bodies: DataFrame) -> DataFrame:
    """``rxcui, codes`` of ``name, body`` class answers, where the name is the concept."""
    items = F.from_json("body", schema.CLASS_RESPONSE)["rxclassDrugInfoList"]["rxclassDrugInfo"]
    return bodies.select(F.col("name").alias("rxcui"), F.transform(items, lambda x: x["rxclassMinConceptItem"]["classId"]).alias("codes"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, body`` of a folder of JSON files, each named after its entity."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("body"))
    return files.select(F.url_decode(F.regexp_extract("f", r"([^/]+?)(?:\.json)?$", 1)).alias("name"), "body")


def ingest_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of finished labels; unreadable lines and a missing file are an empty log."""
    try:
        rows = spark.read.schema(f"{schema.INGEST_LOG}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema.INGEST_LOG)
    return rows.where("set_id is not null").drop("_bad")
