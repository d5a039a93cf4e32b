"""Sufficiency gate, rewriting of intents, and the bounded loop of the two."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import dims
from quillspark.plans.intent import Intent


def gate_facts(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What the gate looks at: hits, best score, hits per layout, newest year, hits with doses; one row, or one per ``by``."""
    by = by or []
    layout = F.coalesce("layout_type", F.lit("unknown"))
    year = F.substring(F.col("label_version_date").cast("string"), 1, 4).try_cast("int")
    doses = F.coalesce(F.size("dose_values") > 0, F.lit(False))
    counts = hits.groupBy(*by, layout.alias("layout")).agg(F.count("*").alias("n"), F.max("maxsim").alias("top"), F.max(year).alias("year"), F.count_if(doses).alias("doses"))
    return counts.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.coalesce(F.max("top"), F.lit(0.0)).alias("top"), F.max("year").alias("newest"), F.coalesce(F.sum("doses"), F.lit(0)).alias("doses"),
        F.map_from_entries(F.collect_list(F.struct("layout", "n"))).alias("coverage"),
    )


def failures(intent: Intent, year: int, floor: float = dims.MIN_SCORE) -> Column:
    """The ordered list of failed conditions over a row of ``gate_facts``."""
    count = lambda layout: F.coalesce(F.try_element_at("coverage", F.lit(layout)), F.lit(0))
    on = lambda x: F.lit(bool(x))
    rules = [
        ("F1", F.col("hits") < dims.MIN_HITS),
        ("F2", (F.col("hits") > 0) & (F.col("top") < floor)),
        ("F3", on(intent.wants_dosing) & (count("dosing") == 0) & (count("structured_fact") == 0)),
        ("F6", on(intent.wants_dosing and intent.population in dims.TITRATED_POPULATIONS) & (F.col("doses") < dims.MIN_DOSE_EVIDENCE)),
        ("F4", on(intent.population) & (F.col("hits") <= dims.FEW_FOR_POPULATION)),
        ("F5", on(intent.wants_interaction and intent.query_type == "causal") & (count("interaction") == 0)),
        ("F7", F.col("newest").isNotNull() & (F.lit(year) - F.col("newest") > dims.RECENT_YEARS)),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def gate(hits: DataFrame, intent: Intent, year: int, floor: float = dims.MIN_SCORE) -> DataFrame:
    return gate_facts(hits).withColumn("failures", failures(intent, year, floor))


def rewritten(intent: Intent, failed: list[str], round_no: int) -> tuple[Intent, set[str]]:
    """The next intent, and which lookups to add (``parents``, ``neighbours``). Layouts are only ever added."""
    f, layouts, lookups, out = set(failed), list(intent.layouts), set(), intent
    if "F4" in f:
        out = out.with_(population=None)
    if "F3" in f and "dosing" not in layouts:
        layouts.insert(0, "dosing")
        out = out.with_(wants_dosing=True)
    if f & {"F6", "F3"}:
        lookups.add("parents")
    if f & {"F6", "F1"} and round_no >= 2:
        lookups.add("neighbours")
    if "F5" in f:
        layouts += [x for x in ("interaction", "pharmacology") if x not in layouts]
        out = out.with_(wants_interaction=True, wants_mechanism=True)
    if f & {"F1", "F2"}:
        question = out.question
        for short, long in dims.ABBREVIATIONS:
            question = re.sub(rf"\b{short}\b", long, question, flags=re.I)
        out = out.with_(question=question)
        layouts += [x for x in dims.FALLBACK_LAYOUTS.get(layouts[0], dims.LAST_FALLBACK) if x not in layouts]
    if "F7" in f:
        out = out.with_(date_from="2010-01-01")
    return out.with_(layouts=tuple(layouts)), lookups


def reflect(
    intent: Intent, retrieve: Callable[[Intent, int], DataFrame], lookup: Callable[[str, DataFrame, Intent], DataFrame], year: int,
    keep: Callable[[DataFrame, str], DataFrame], max_rounds: int = dims.MAX_ROUNDS, floor: float = dims.MIN_SCORE,
) -> tuple[DataFrame, list[dict], Intent]:
    """Hits gathered over at most ``max_rounds`` rounds, a report per round, and the last intent.

    ``retrieve`` gives the few re-ranked hits of a round, ``lookup`` the hits of an added lookup; ``keep``
    makes a small table durable. Only one row per round, the gate's, reaches the driver. A key keeps its first hit.
    """
    hits, reports = None, []
    for round_no in range(1, max_rounds + 1):
        fresh = retrieve(intent, round_no).withColumn("round", F.lit(round_no))
        hits = keep(fresh if hits is None else hits.unionByName(fresh.join(hits.select("urn_id"), "urn_id", "left_anti"), allowMissingColumns=True), f"hits-{round_no}")
        row = gate(hits, intent, year, floor).first()
        reports.append({"round": round_no, "hits": row.hits, "top": row.top, "failures": list(row.failures)})
        if not row.failures or round_no == max_rounds:
            break
        intent, lookups = rewritten(intent, row.failures, round_no)
        for name in sorted(lookups):
            extra = lookup(name, hits, intent).withColumn("round", F.lit(round_no))
            hits = keep(hits.unionByName(extra.join(hits.select("urn_id"), "urn_id", "left_anti"), allowMissingColumns=True), f"hits-{name}")
    return hits, reports, intent
