"""Sinks: the artifact table (upsert by key), the log of finished labels, JSON lines, and a pluggable generator."""

from __future__ import annotations

import datetime
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.operators.ingest import upsert
from quillspark.runtime import stage


def create_table(spark: SparkSession, path: str, columns: str = schema.ARTIFACT, partition: str | None = "layout_type", force: bool = False) -> None:
    """An empty Parquet table unless there is one; ``force`` replaces it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if not there or force:
        writer = spark.createDataFrame([], columns).write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(path)


def upsert_table(spark: SparkSession, path: str, rows: DataFrame, key: str, newest_first: list[Column], partition: str = "layout_type", columns: str | None = schema.ARTIFACT) -> None:
    """Last writer wins per key. Only partitions that gain or lose rows are written again; errors are raised.

    The new state is staged first, so that a failure leaves the table as it was.
    """
    old = spark.read.schema(columns).parquet(path) if columns else spark.read.parquet(path)
    fresh = stage(rows, "upsert-source")
    touched = stage(fresh.select(partition).union(old.join(fresh.select(key), key, "left_semi").select(partition)).distinct(), "upsert-partitions")
    part = old.join(F.broadcast(touched), partition, "left_semi").select(*old.columns)
    new = stage(upsert(part, fresh, key, newest_first), "upsert-result")
    new.write.mode("overwrite").partitionBy(partition).option("partitionOverwriteMode", "dynamic").parquet(path)
    emptied = touched.join(new.select(partition).distinct(), partition, "left_anti").collect()
    for row in emptied:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={row[0] if row[0] is not None else '__HIVE_DEFAULT_PARTITION__'}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark_done(artifacts: DataFrame, path: str, when: Column | None = None) -> None:
    """Appends one line per label with its number of artifacts."""
    done = artifacts.groupBy("set_id").agg(F.min("drug_name_generic").alias("drug_generic"), F.count("*").alias("n_docs"), (when if when is not None else F.current_timestamp()).alias("completed_at"))
    done.write.mode("append").json(path)


def mark_phase(spark: SparkSession, path: str, phase: str) -> None:
    """Notes that a phase of the run with the log ``path`` is done, next to the log."""
    spark.createDataFrame([(phase,)], "phase string").withColumn("completed_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}-phases")


def is_phase_done(spark: SparkSession, path: str, phase: str) -> bool:
    try:
        return not spark.read.schema("phase string, completed_at timestamp").json(f"{path.rstrip('/')}-phases").where(F.col("phase") == phase).isEmpty()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False


def reset(spark: SparkSession, path: str) -> None:
    """Forgets the log and the phases."""
    for name in (path, f"{path.rstrip('/')}-phases"):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class JsonLog:
    """JSON lines of driver-side events; values that JSON can't hold are written as text."""

    def __init__(self, path: str, clock: Callable[[], datetime.datetime] = lambda: datetime.datetime.now(datetime.UTC)) -> None:
        self.path, self.clock = path, clock
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)

    def __call__(self, message: str, level: str = "INFO", **fields: object) -> None:
        line = {"ts": self.clock().isoformat(), "level": level, "message": message, **fields}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(line, default=str) + "\n")


class Timer:
    """Milliseconds of a block, to one decimal, logged when it ends."""

    def __init__(self, log: JsonLog, name: str, **fields: object) -> None:
        self.log, self.name, self.fields, self.ms = log, name, fields, 0.0

    def __enter__(self) -> Timer:
        self.start = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        self.ms = round((time.perf_counter() - self.start) * 1000, 1)
        self.log(self.name, elapsed_ms=self.ms, **self.fields)


def answer_text(response: dict) -> str:
    """The text of a generator's answer: its ``text``, else the parts of its first candidate; an empty answer is an error."""
    text = response.get("text")
    if not text:
        candidates = response.get("candidates") or [{}]
        text = "\n".join(p["text"] for p in ((candidates[0].get("content") or {}).get("parts") or []) if p.get("text"))
    if not text or not text.strip():
        raise ValueError("the generator returned no text")
    return text


def generate(prompt: str, generator: Callable[[str], dict]) -> str:
    """Sends a prompt to any callable and returns the text of its answer."""
    return answer_text(generator(prompt))
