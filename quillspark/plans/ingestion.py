"""Ingest from end to end: names to labels, labels to artifacts with vectors, upsert, log.

One run over all names is a few jobs; labels that the log has are skipped before anything costly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.functions import vectors
from quillspark.operators import ingest
from quillspark.runtime import stage
from quillspark.sources import labels as L
from quillspark.sources import sinks

#: ``names -> name, body``; from HTTP, from files, or from a table.
Fetch = Callable[[list[str]], DataFrame]


@dataclass
class Sources:
    concepts: Fetch
    classes: Fetch
    labels: Fetch
    fallback: Fetch | None = None


def http_sources(spark: SparkSession, concepts_url: str, classes_url: str, labels_url: str, fallback_url: str | None = None, **options: object) -> Sources:
    """Sources that ask one URL per name; ``{name}`` in a URL stands for the name.

    Concepts and classes are asked once, without repetition, at their own pace.
    """
    at = lambda url, **own: lambda names: L.read_http(spark, url, names, **(own | options))
    once = {"retries": 1, "delay": 0.2, "timeout": 15, "wait": 0}
    return Sources(at(concepts_url, **once), at(classes_url, **once), at(labels_url), at(fallback_url) if fallback_url else None)


def ingest_names(
    spark: SparkSession, names: list[str], sources: Sources, table: str, log: str, limit: int | None = None, reset: bool = False, represent: Callable | None = None
) -> dict[str, object]:
    """Takes the labels of ``names`` (the first ``limit``) into ``table`` and the log.

    Returns ``labels`` and ``documents`` taken in, ``skipped`` labels that were done, and ``failed`` names
    without concept or label. ``reset`` forgets the log first. The names are plan-time input, one request each.
    """
    if reset:
        sinks.reset(spark, log)
    wanted = list(dict.fromkeys(n.strip().lower() for n in names if n.strip()))[:limit]
    asked = spark.createDataFrame([(n,) for n in wanted], "name string")
    concepts = stage(L.concepts(sources.concepts(wanted)), "concepts")
    codes = [r.rxcui for r in concepts.select("rxcui").distinct().collect()]
    found = L.preferred(L.labels(sources.labels(wanted)))
    resolved = stage(ingest.resolve(asked, concepts, L.classes(sources.classes(codes)), found, L.labels(sources.fallback(wanted)) if sources.fallback else None), "resolved")
    entities = ingest.entities(resolved)
    fresh = stage(ingest.not_done(entities, L.ingest_log(spark, log)), "entities")
    rows = ingest.sparse(ingest.artifacts(fresh))
    for name in ("interaction_ids", "table_ref"):
        rows = rows.withColumn(name, F.lit(None).cast("array<string>"))
    rows = rows.withColumn("raptor_cluster", F.lit(None).cast("string")).withColumn("r", (represent or vectors.represent())(F.col("verbatim_text"))).select("*", "r.*").drop("r")
    rows = stage(rows, "artifacts")
    sinks.create_table(spark, table, schema.INDEX)
    sinks.upsert_table(spark, table, rows, "urn_id", [F.desc("set_id")], columns=schema.INDEX)
    sinks.mark_done(rows, log)
    sinks.mark_phase(spark, log, "ingest")
    done = {r.name for r in resolved.select("name").collect()}
    new, all_ = fresh.count(), entities.count()
    return {"labels": new, "documents": rows.count(), "skipped": all_ - new, "failed": [n for n in wanted if n not in done]}
