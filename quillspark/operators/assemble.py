"""Hits to an answer's evidence: nodes, verbatim locks, calibration, expansion, conflicts, prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import dims
from quillspark.functions.text import escape_markup

#: Reference lists of a node and the section their targets go to.
REFERENCES = {"interaction_ids": "causal", "raptor_cluster": "macro", "table_ref": "tables"}


def nodes(hits: DataFrame) -> DataFrame:
    """Hits with defaults: empty strings, risk 0, confidence 1, empty lists; a legacy scalar dose becomes a list."""
    have, kinds = set(hits.columns), dict(hits.dtypes)
    out = {}
    for name, kind in kinds.items():
        if kind == "string":
            out[name] = F.coalesce(name, F.lit(""))
        elif kind.startswith("array") and name not in ("content_vector", "token_vecs", "muvera_fde", "fde"):
            out[name] = F.coalesce(F.col(name), F.array().cast(kind))
    if "raglens_risk" in have:
        out["raglens_risk"] = F.coalesce("raglens_risk", F.lit(0.0))
    if "chunk_confidence" in have:
        out["chunk_confidence"] = F.coalesce("chunk_confidence", F.lit(1.0))
    for plural, single in (("dose_values", "dose_val"), ("dose_units", "dose_unit")):
        if {plural, single} <= have:
            out[plural] = F.when(F.size(plural) > 0, F.col(plural)).when(F.col(single).isNotNull(), F.array(single)).otherwise(F.array().cast(kinds[plural]))
    return hits.withColumns(out)


def locked(df: DataFrame, threshold: float = dims.VERBATIM_RISK) -> DataFrame:
    return df.withColumn("verbatim_locked", F.col("raglens_risk") >= threshold)


def calibrated(df: DataFrame, index: DataFrame, floor: float = 0.6, trusted: float = 0.9, parity: bool = False) -> DataFrame:
    """Marks nodes of low confidence: ``calibration`` is ``trusted``, ``verified`` by a reliable dose fact of the same drug, or ``unverified``.

    One aggregation of the index by drug replaces a lookup per node. ``parity``: only the layout
    ``dosing`` is searched, and a fact without values verifies too.
    """
    layouts = ["dosing"] if parity else dims.DOSE_LAYOUTS
    facts = index.where(F.col("layout_type").isin(layouts) & (F.col("chunk_confidence") >= trusted) & F.col("rxcui").isNotNull())
    if not parity:
        facts = facts.where(F.size("dose_values") > 0)
    best = facts.groupBy("rxcui").agg(F.max_by(F.struct(F.col("urn_id").alias("fact_urn"), F.col("dose_values").alias("fact_values")), F.struct("chunk_confidence", "urn_id")).alias("fact"))
    state = F.when(F.col("chunk_confidence") >= floor, "trusted").when(F.col("fact").isNotNull(), "verified").otherwise("unverified")
    return df.join(best, "rxcui", "left").withColumn("calibration", state).withColumn("fact_urn", F.when(F.col("calibration") == "verified", F.col("fact.fact_urn"))).drop("fact")


def expansion(df: DataFrame, index: DataFrame, columns: list[str], limit: int | None = 100) -> DataFrame:
    """The index rows that the nodes' reference lists name, once each, with their section; dangling references drop out."""
    refs = None
    for c in columns:
        values = F.explode(F.col(c)) if dict(df.dtypes)[c].startswith("array") else F.col(c)
        one = df.select(values.alias("ref"), F.lit(REFERENCES.get(c, c)).alias("section"))
        refs = one if refs is None else refs.unionByName(one)
    refs = refs.where("ref is not null and ref <> ''").distinct()
    if limit is not None:
        refs = refs.orderBy("ref", "section").limit(limit)
    return index.join(refs.withColumnRenamed("ref", "urn_id"), "urn_id")


def parents(hits: DataFrame, index: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` distinct parents of the hits, in hit order (``rank``), with score 0 and a tag."""
    first = hits.where("parent_urn is not null and parent_urn <> ''").groupBy("parent_urn").agg(F.min("rank").alias("rank")).orderBy("rank", "parent_urn").limit(most)
    return index.join(F.broadcast(first.withColumnRenamed("parent_urn", "urn_id")), "urn_id").withColumn("maxsim", F.lit(0.0)).withColumn("origin", F.lit("parent"))


def class_neighbours(index: DataFrame, codes: DataFrame, layout: str | None = None, prefix: int = 4) -> DataFrame:
    """Index rows whose class shares a prefix with one of ``codes`` (``atc_code``); shorter codes are ignored."""
    wanted = codes.where(F.length("atc_code") >= prefix).select(F.substring("atc_code", 1, prefix).alias("_p")).distinct()
    rows = index if layout is None else index.where(F.col("layout_type") == layout)
    return rows.withColumn("_p", F.substring("atc_code", 1, prefix)).join(wanted, "_p", "left_semi").drop("_p")


def conflicts(df: DataFrame, keys: list[str], values: str, urn: str, share: float = dims.CONFLICT_SHARE, gather: bool = True) -> DataFrame:
    """Groups of at least two rows whose values differ by more than ``share`` of the least.

    ``values`` is a list or number column. A group whose least value is 0 is skipped, and so are rows without values.
    Counts and extremes decide first, with map-side combining; only the rows of conflicting groups are then read for
    their distinct ``values`` and row keys (``urns``), unless ``gather`` is off.
    """
    is_list = dict(df.dtypes)[values].startswith("array")
    v = F.filter(F.col(values), lambda x: x.isNotNull()) if is_list else F.when(F.col(values).isNotNull(), F.array(values)).otherwise(F.array().cast(f"array<{dict(df.dtypes)[values]}>"))
    rows = df.select(*keys, F.col(urn).alias("_u"), v.alias("_v")).where(F.size("_v") > 0)
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("nodes"), F.min(F.array_min("_v")).alias("least"), F.max(F.array_max("_v")).alias("most"))
    pct = F.abs(F.col("most") - F.col("least")) / F.col("least")
    found = grouped.where("nodes >= 2 and least <> 0").withColumn("pct_diff", pct).where(F.col("pct_diff") > share).drop("least", "most")
    if not gather:
        return found
    named = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "nodes", "pct_diff")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # Distinct pairs first, so that a hot group sends each value and key once per task.
    members = rows.join(named, same)
    values_of = members.select(*keys, F.explode("_v").alias("x")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("values"))
    urns_of = members.select(*keys, "_u").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("_u")).alias("urns"))
    for extra, column in ((values_of, "values"), (urns_of, "urns")):
        e = extra.select(column, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        found = found.join(e, cond, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return found


def dose_conflicts(df: DataFrame, parity: bool = False) -> DataFrame:
    """Conflicting doses of one drug, route and population (and unit, unless ``parity``)."""
    rows = df.where(F.col("layout_type").isin(["dosing"] if parity else dims.DOSE_LAYOUTS))
    rows = rows.withColumns({"drug": F.col("drug_name_generic"), "route": F.coalesce(F.nullif(F.col("dose_route"), F.lit("")), F.lit("any")), "population": F.coalesce(F.nullif(F.col("patient_population"), F.lit("")), F.lit("general"))})
    keys = ["drug", "route", "population"]
    if not parity:
        rows, keys = rows.withColumn("units", F.array_join(F.coalesce("dose_units", F.array().cast("array<string>")), ",")), [*keys, "units"]
    return conflicts(rows, keys, "dose_values", "urn_id")


def summary(df: DataFrame) -> DataFrame:
    """``section, nodes`` for the sections that have nodes."""
    return df.groupBy("section").agg(F.count("*").alias("nodes"))


# The directives at the head of a prompt, its closing steps, and the note for a missing verbatim section.
DIRECTIVES = [
    "You are a deterministic clinical reasoning engine. You operate under ZERO-HALLUCINATION rules.",
    "1. CITATION MANDATE: Every clinical claim must end with its source URN -> [SOURCE: urn:pharma:fda_us:rxcui:...]",
    "2. VERBATIM ENFORCEMENT: Nodes marked <verbatim_locked> contain numerical or dosing data. You MUST quote exact constraints. DO NOT paraphrase doses or frequencies.",
    "3. NO EXTERNAL KNOWLEDGE: If the provided evidence cannot answer the query, output exactly: '⚠ INSUFFICIENT EVIDENCE: The provided label data does not contain enough information to answer safely.'",
    "4. CONFLICT RESOLUTION: If a <dose_conflict_warning> is present, you MUST present both values and cite both sources.",
    "5. EVIDENCE AUDIT: {dosed} node(s) in this context contain dose metadata. If this number is 0 for a dosing question, follow rule 3.",
    "6. RETRIEVAL METADATA: {rounds} reflection round(s) were used to build this context.",
]
PROTOCOL = [
    "Step 1: Identify the temporal anchors of the evidence and prefer the most recent label data.",
    "Step 2: Count nodes with has_dose_metadata='true'. If none exist for a dosing request, follow rule 3.",
    "Step 3: If scope='atc_class_level', state clearly that the evidence is class-level rather than drug-specific.",
    "Step 4: Map the <causal_mechanisms> to the <query_intent> for interaction or 'why' questions.",
    "Step 5: Extract exact numerical constraints from <verbatim_locked_nodes>.",
]
NO_VERBATIM = "  <!-- NO verbatim-locked dosing nodes retrieved -->"
# Tag and type of each section of a prompt, in order, and the element that holds a node's text.
PROMPT_SECTIONS = [
    ("verbatim", "verbatim_locked_nodes type='primary_dosing_and_warnings'", "exact_quote"),
    ("paraphrase", "supporting_nodes type='paraphrasable_context'", "content"),
    ("causal", "causal_mechanisms type='drug_interactions'", "mechanism_explanation"),
    ("macro", "macro_context type='atc_class_summary'", "class_insight"),
    ("tables", "structured_tables", "table_data"),
]


def listed(values: Column) -> Column:
    """A list as text in brackets, strings in quotes."""
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def node_markup(columns: dict[str, str]) -> Column:
    """The evidence node of a row as markup, by its ``section``; ``columns`` names and types what there is."""
    x = escape_markup
    have = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in columns else F.lit(default)
    text = lambda c, default="": x(F.when(have(c, "") == "", default).otherwise(have(c, default)))
    dosed = F.coalesce(F.size("dose_values") > 0, F.lit(False)) if "dose_values" in columns else F.lit(False)
    values = listed(F.transform("dose_values", lambda v: v.cast("string"))) if "dose_values" in columns else F.lit("[]")
    units = listed(F.transform("dose_units", lambda u: F.concat(F.lit("'"), u, F.lit("'")))) if "dose_units" in columns else F.lit("[]")
    said = lambda cond: F.when(cond, "true").otherwise("false")
    boxed = F.coalesce(F.col("boxed_warning"), F.lit(False)) if "boxed_warning" in columns else F.lit(False)
    scope = F.when(F.col("origin") == "class", "atc_class_level").otherwise("drug_specific") if "origin" in columns else F.lit("drug_specific")
    urn, kind, date, drug, quote = text("urn_id"), text("layout_type"), text("label_version_date", "unknown"), text("drug_name_generic"), text("verbatim_text")
    open_, close = lambda *attributes: F.concat(F.lit("    <artifact"), *attributes, F.lit(">")), F.lit("    </artifact>")
    attr = lambda name, value: F.concat(F.lit(f" {name}='"), value, F.lit("'"))
    body = lambda tag: F.concat(F.lit(f"      <{tag}>"), quote, F.lit(f"</{tag}>"))
    tags = {name: tag for name, _, tag in PROMPT_SECTIONS}
    verbatim = F.concat_ws(
        "\n",
        open_(attr("urn", urn), attr("type", kind), attr("boxed_warning", said(boxed)), attr("has_dose_metadata", said(dosed)), attr("temporal_anchor", date)),
        F.concat(F.lit("      <drug>"), drug, F.lit("</drug>")),
        F.concat(F.lit("      <context"), attr("population", text("patient_population", "general")), attr("route", text("dose_route", "unspecified")), F.lit("/>")),
        F.when(dosed, F.concat(F.lit("      <dose_metadata"), attr("values", x(values)), attr("units", x(F.coalesce(units, F.lit("[]")))), F.lit("/>"))),
        body(tags["verbatim"]), close,
    )
    one_line = lambda section, *attributes: F.concat(open_(*attributes), body(tags[section]), close)
    return (
        F.when(F.col("section") == "verbatim", verbatim)
        .when(F.col("section") == "paraphrase", one_line("paraphrase", attr("urn", urn), attr("type", kind), attr("scope", scope), attr("temporal_anchor", date)))
        .when(F.col("section") == "causal", one_line("causal", attr("urn", urn), attr("drug", drug)))
        .when(F.col("section") == "macro", one_line("macro", attr("urn", urn), attr("class", text("atc_code"))))
        .otherwise(one_line("tables", attr("urn", urn)))
    )


def conflict_markup() -> Column:
    """A conflict, a row of ``dose_conflicts``, as a warning."""
    x = escape_markup
    return F.concat(
        F.lit("  <conflict drug='"), x(F.coalesce("drug", F.lit(""))), F.lit("' route='"), x(F.col("route")), F.lit("' population='"), x(F.col("population")), F.lit("'>Values found: "),
        x(listed(F.transform("values", lambda v: v.cast("string")))), F.lit(" ("), F.round(F.col("pct_diff") * 100).cast("bigint").cast("string"), F.lit("% difference). Sources: "),
        F.array_join(F.transform("urns", x), ", "), F.lit(".</conflict>"),
    )


def _in_section(name: str) -> Callable[[Column], Column]:
    return lambda x: x["section"] == name


def prompt(
    evidence: DataFrame, question: str, query_type: str = "factual", drugs: list[str] | None = None, population: str | None = None, rounds: int = 1, conflicts: DataFrame | None = None
) -> DataFrame:
    """``prompt``: one row with directives, intent, conflicts, the evidence by section and rank, closing steps and the question.

    ``evidence``: ``section, rank, urn_id, layout_type, label_version_date, drug_name_generic, verbatim_text`` and what
    there is of ``boxed_warning, dose_values, dose_units, dose_route, patient_population, atc_code, origin``. The evidence of
    one question is small by construction (the re-ranked hits). Sections without nodes are left out, except the
    verbatim one, which gets a note. ``conflicts``: rows of ``dose_conflicts`` over the evidence.
    """
    kinds = dict(evidence.dtypes)
    dosed = F.count_if(F.size("dose_values") > 0) if "dose_values" in kinds else F.lit(0)
    ordered = F.array_sort(F.collect_list(F.struct("section", "rank", "urn_id", "markup")))
    whole = evidence.withColumn("markup", node_markup(kinds)).agg(ordered.alias("all"), dosed.alias("dosed"))
    if conflicts is not None:
        warned = conflicts.select(conflict_markup().alias("c")).agg(F.array_join(F.array_sort(F.collect_list("c")), "\n").alias("warnings"))
        whole = whole.join(F.broadcast(warned))
    else:
        whole = whole.withColumn("warnings", F.lit(""))
    lines = [F.lit("<system_directives>")]
    for line in DIRECTIVES:
        before, _, after = line.format(dosed="\u0001", rounds=rounds).partition("\u0001")
        lines.append(F.concat(F.lit(before), F.col("dosed").cast("string"), F.lit(after)) if after else F.lit(before))
    lines += [F.lit("</system_directives>\n"), F.lit("<query_intent>"), F.concat(F.lit("<type>"), escape_markup(F.lit(query_type.upper())), F.lit("</type>"))]
    lines.append(F.concat(F.lit("<target_drugs>"), escape_markup(F.lit(", ".join(drugs or []) or "not specified")), F.lit("</target_drugs>")))
    lines.append(F.concat(F.lit("<target_population>"), escape_markup(F.lit(population or "general")), F.lit("</target_population>")))
    lines.append(F.lit("</query_intent>\n"))
    lines.append(F.when(F.col("warnings") != "", F.concat(F.lit("<dose_conflict_warnings>\n"), F.col("warnings"), F.lit("\n</dose_conflict_warnings>\n"))))
    lines.append(F.lit("<clinical_evidence>"))
    for name, tag, _ in PROMPT_SECTIONS:
        own = F.transform(F.filter("all", _in_section(name)), lambda x: x["markup"])
        section = F.concat(F.lit(f"  <{tag}>\n"), F.array_join(own, "\n"), F.lit(f"\n  </{tag.split()[0]}>\n"))
        lines.append(F.when(F.size(own) > 0, section).otherwise(F.lit(f"{NO_VERBATIM}\n") if name == "verbatim" else F.lit(None)))
    lines += [F.lit(x) for x in ("</clinical_evidence>\n", "<reasoning_protocol>", *PROTOCOL, "</reasoning_protocol>\n", "<user_query>")]
    lines += [escape_markup(F.lit(question)), F.lit("</user_query>")]
    return whole.select(F.concat_ws("\n", *lines).alias("prompt"))
