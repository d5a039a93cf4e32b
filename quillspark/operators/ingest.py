"""Labels to artifacts: entity resolution, sections, chunks, facts, keys, upsert and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import dims
from quillspark.functions import text as T
from quillspark.functions.html import html_to_text
from quillspark.operators import facts
from quillspark.runtime import stage


def latest_per_key(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key, the first of the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))).where("_rn = 1").drop("_rn")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "seq") -> DataFrame:
    """``df`` with a running number from 0 within the keys, in an order without ties; null keys are one key.

    The rows are range-partitioned by key and order and numbered within their partition; prefix sums over the (few)
    partitions that share a key add the rest. So no task ever holds more than its range, however hot a key is.
    """
    spread = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *order)
    ranged = stage(spread.withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before > 0")
    local = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)) - 1)
    o = offsets.select("_before", F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(F.broadcast(o), same, "left")  # at most one key continues into a range
    return joined.select(*df.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name))


def class_code(codes: Column, default: str = "ZZZZ") -> Column:
    """The first code of five characters, else the first, else the default (also for an empty string)."""
    five = F.get(F.filter(codes, lambda c: F.length(c) == 5), F.lit(0))
    return F.coalesce(F.nullif(F.coalesce(five, F.get(codes, F.lit(0))), F.lit("")), F.lit(default))


def iso_date(text: Column) -> Column:
    """A date from ``yyyymmdd``; null unless there are eight characters that form a date."""
    return F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd"))


def label_date(text: Column) -> Column:
    """A date from ``yyyymmdd`` or ``yyyy-mm-dd``; null for anything else."""
    return F.coalesce(iso_date(text), F.try_to_date(text, "yyyy-MM-dd"))


def resolve(names: DataFrame, concepts: DataFrame, classes: DataFrame, labels: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """``name -> rxcui -> class, label``: names without concept or label drop out, a missing class is ``ZZZZ``.

    ``concepts`` (``name, rxcui``), ``classes`` (``rxcui, codes``), ``labels`` and ``fallback`` (``name, result``).
    A label of ``fallback`` is used only where ``labels`` has none.
    """
    found = names.join(concepts, "name").join(classes, "rxcui", "left")
    if fallback is not None:
        both = labels.withColumn("_p", F.lit(0)).unionByName(fallback.withColumn("_p", F.lit(1)))
        labels = latest_per_key(both, ["name"], [F.col("_p"), F.to_json("result")]).drop("_p")
    return found.join(labels, "name").withColumn("atc_code", class_code(F.col("codes"))).drop("codes")


def entities(resolved: DataFrame) -> DataFrame:
    """The label entity of each resolved ``name, rxcui, atc_code, result``."""
    r = F.col("result")
    date = iso_date(r["effective_time"])
    return resolved.select(
        F.coalesce(r["set_id"], F.concat(F.lit("unknown-"), "rxcui")).alias("set_id"), "rxcui",
        F.lower(F.coalesce(F.get(r["openfda"]["generic_name"], F.lit(0)), F.col("name"))).alias("drug_generic"),
        F.transform(F.coalesce(r["openfda"]["brand_name"], F.array().cast("array<string>")), F.initcap).alias("drug_brand"),
        "atc_code", date.alias("label_date"), date.alias("published"),
        F.coalesce(F.size(r["boxed_warning"]) > 0, F.lit(False)).alias("boxed_warning"), F.lit("fda_us").alias("source"), "result",
    )


def sections(labels: DataFrame) -> DataFrame:
    """Wide to long in declared order: a ``*_table`` field that is not empty replaces its prose field."""
    present = set(labels.schema["result"].dataType.names)
    entries = []
    for i, (field, code, layout) in enumerate(dims.SECTIONS):
        own = [F.col("result")[c] for c in (f"{field}_table", field) if c in present]
        if own:
            parts = F.coalesce(*[F.when(F.size(c) > 0, c) for c in own])
            entries.append(F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"), F.lit(layout).alias("layout_type"), parts.alias("parts")))
    long = labels.withColumn("s", F.explode(F.array(*entries))).select(*[c for c in labels.columns if c != "result"], "s.*")
    return long.where("parts is not null")


def risk_of(layout: Column, boxed: Column) -> Column:
    """The layout's risk (0.5 if unknown), with the surcharge of boxed warnings, at most 1; double precision throughout."""
    base = None
    for name, risk in dims.LAYOUT_RISK:
        base = F.when(layout == name, F.lit(risk)) if base is None else base.when(layout == name, F.lit(risk))
    base = base.otherwise(F.lit(dims.DEFAULT_RISK))
    return F.least(F.lit(1.0), base + F.when(boxed, F.lit(dims.BOXED_SURCHARGE)).otherwise(F.lit(0.0)))


def artifacts(labels: DataFrame) -> DataFrame:
    """Chunks and dose facts of labels (as ``entities`` gives them), with keys.

    Chunks shorter than 80 characters and repeated chunks of a label are dropped; a running number per
    label counts chunks and, right after each, its facts.
    """
    each = sections(labels).select("*", F.posexplode("parts").alias("part_no", "html")).drop("parts")
    plain = each.withColumn("t", html_to_text(F.col("html"))).drop("html")
    keys = [c for c in plain.columns if c not in ("part_no", "t")]
    #: The parts of one section of one label are one document's text.
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part_no", "t"))), lambda x: F.trim(x["t"]))
    return artifacts_of_texts(plain.groupBy(*keys).agg(F.array_join(texts, " \n").alias("text")))


def artifacts_of_texts(texts: DataFrame) -> DataFrame:
    """``artifacts`` of section texts: the columns of a label, ``ord, code, layout_type`` of the section and its ``text``.

    Sections stay rows of their own throughout, so a label with any number of them is never held by one task.
    """
    whole = texts.withColumn("text", F.when(F.col("layout_type") == "dosing", T.normalise_dosing(F.col("text"))).otherwise(F.col("text")))
    chunked = whole.select("*", F.posexplode(T.chunks(F.col("text"))).alias("chunk_no", "verbatim_text")).drop("text").where(F.length("verbatim_text") >= dims.MIN_CHUNK)
    first = latest_per_key(chunked.withColumn("h", F.sha2("verbatim_text", 256)), ["set_id", "h"], [F.col("ord"), F.col("chunk_no")]).drop("h")

    sents = F.filter(F.transform(T.sentences(F.col("verbatim_text")), F.trim), lambda s: T.is_dose_sentence(s) & (F.size(facts.dose_values(s)) > 0))
    rows = first.withColumn("s", F.when(F.col("layout_type").isin(dims.FACT_LAYOUTS), sents).otherwise(F.array().cast("array<string>")))
    rows = rows.select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "s")).alias("fact_no", "fact")).drop("s")
    f = F.col("fact")
    rows = rows.withColumns({"dose_values": facts.dose_values(f), "dose_units": facts.dose_units(f), "dose_route": F.when(f.isNotNull(), facts.route(f)), "patient_population": F.when(f.isNotNull(), facts.population(f))})
    rows = numbered(rows, ["set_id"], [F.col("ord"), F.col("chunk_no"), F.col("fact_no")])
    parent_seq = F.col("seq") - F.col("fact_no")
    rows = rows.withColumn("chunk_urn", T.artifact_urn(F.col("source"), F.col("rxcui"), F.col("set_id"), F.col("layout_type"), parent_seq))
    fact_urn = T.fact_urn(F.col("rxcui"), F.col("set_id"), F.col("dose_route"), F.col("patient_population"), F.col("seq"), f)
    is_fact = f.isNotNull()
    return rows.select(
        F.when(is_fact, fact_urn).otherwise(F.col("chunk_urn")).alias("urn_id"), F.when(is_fact, F.col("chunk_urn")).alias("parent_urn"), "set_id", "rxcui",
        F.when(is_fact, "structured_fact").otherwise(F.col("layout_type")).alias("layout_type"), F.coalesce("fact", "verbatim_text").alias("verbatim_text"),
        F.lit(0.97).alias("chunk_confidence"), risk_of(F.col("layout_type"), F.col("boxed_warning")).alias("raglens_risk"), F.col("label_date").alias("label_version_date"), F.col("published").alias("published_date"),
        F.col("drug_generic").alias("drug_name_generic"), F.col("drug_brand").alias("drug_name_brand"), "atc_code", F.col("code").alias("smpc_section_code"), "boxed_warning", F.col("source").alias("regulatory_source"),
        *[F.when(is_fact, F.col(c)).alias(c) for c in ("dose_values", "dose_units", "dose_route", "patient_population")],
    )


def sparse(df: DataFrame) -> DataFrame:
    """Empty lists become null."""
    return df.withColumns({n: F.when(F.size(n) > 0, F.col(n)) for n, t in df.dtypes if t.startswith("array")})


def not_done(df: DataFrame, log: DataFrame, key: str = "set_id") -> DataFrame:
    """Rows whose key is not in the log; a null key is never in it."""
    return df.join(log.select(key).distinct(), key, "left_anti")


def upsert(target: DataFrame, source: DataFrame, key: str, newest_first: list[Column]) -> DataFrame:
    """The target with the source's latest row of every key put in its place."""
    fresh = latest_per_key(source, [key], newest_first)
    return target.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*target.columns))


def log_totals(log: DataFrame) -> DataFrame:
    """``labels, documents``: keys once, documents every time they were logged."""
    return log.agg(F.countDistinct("set_id").alias("labels"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("documents"))
