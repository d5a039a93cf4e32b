import pytest
from pyspark.sql import functions as F

from quillspark import dims
from quillspark.operators import assemble, audit, ingest
from quillspark.plans import intent as I
from quillspark.plans import reflect

HIT = "urn_id string, layout_type string, label_version_date string, maxsim double, dose_values array<double>"


def test_intent_parity_and_fixed():
    q = "What is the standard apixaban dosing"
    parity, fixed = (I.intent_of(q, {"apixaban"}, 2026, parity=p) for p in (True, False))
    assert parity.query_type == "factual" and parity.layouts == ("dosing",) and parity.drugs == ("apixaban",)
    assert parity.wants_interaction and not fixed.wants_interaction
    assert parity.pools() == ["dosing", "interaction"] and fixed.pools() == ["dosing"]
    assert I.intent_of("any contraindication", parity=True).layouts == ("contraindication", "indication")
    assert I.intent_of("any contraindication").layouts == ("contraindication",)
    assert I.intent_of("What is it", parity=True).drugs == ("what",) and I.intent_of("What is it").drugs == ()


def test_intent_years():
    assert I.intent_of("labels from 2019 to 2021").date_from == "2019-01-01"
    assert not I.intent_of("give 2000 mg").explicit_years and I.intent_of("give 2000 mg", parity=True).explicit_years


def test_name_dictionary_prefers_longest():
    assert I.drug_names("use Insulin Glargine now", {"insulin", "insulin glargine"}) == ("insulin glargine",)


@pytest.mark.parametrize(("population", "codes"), [("renal_impairment", ["F1", "F3", "F6", "F4"]), (None, ["F1", "F3"])])
def test_gate_without_hits(spark, population, codes):
    asked = I.Intent("q", population=population, wants_dosing=True)
    assert reflect.gate(spark.createDataFrame([], HIT), asked, 2026).first().failures == codes


def test_gate_passes_and_stale_labels(spark):
    hits = spark.createDataFrame([(f"u{i}", "dosing", d, 0.9, [1.0]) for i, d in enumerate(["2025-01-01", "bad", None])], HIT)
    asked = I.Intent("q", wants_dosing=True)
    assert reflect.gate(hits, asked, 2026).first().failures == []
    assert reflect.gate(hits, asked, 2029).first().failures == ["F7"]


def test_rewriting_only_adds_layouts():
    asked = I.Intent("dose in ckd", layouts=("dosing",), population="renal_impairment", wants_dosing=True)
    new, lookups = reflect.rewritten(asked, ["F1", "F4", "F6", "F7"], 2)
    assert new.layouts[:1] == ("dosing",) and set(new.layouts) > {"dosing"}
    assert new.population is None and "chronic kidney disease" in new.question and new.date_from == "2010-01-01"
    assert lookups == {"parents", "neighbours"}


def test_reflection_keeps_first_hits(spark):
    made = []

    def retrieve(asked, n):
        made.append(asked.layouts)
        return spark.createDataFrame([("a", "dosing", "2025", 0.5, [1.0]), (f"r{n}", "dosing", "2025", 0.5, None)], HIT)

    hits, reports, last = reflect.reflect(I.Intent("q", layouts=("dosing",), wants_dosing=True), retrieve, lambda *_: spark.createDataFrame([], HIT), 2026, lambda df, _: df)
    assert {(r.urn_id, r["round"]) for r in hits.collect()} == {("a", 1), ("r1", 1), ("r2", 2)}
    assert [r["failures"] for r in reports] == [["F1"], []] and len(made[1]) > len(made[0])


@pytest.mark.parametrize(("values", "found"), [([[5.0], [5.5]], []), ([[5.0], [6.0]], [0.2]), ([[5.0, 10.0]], []), ([[0.0], [6.0]], []), ([[5.0], None, [None, 7.0]], [0.4])])
def test_conflicts(spark, values, found):
    df = spark.createDataFrame([("d", f"u{i}", v) for i, v in enumerate(values)], "drug string, urn string, v array<double>")
    assert [round(r.pct_diff, 6) for r in assemble.conflicts(df, ["drug"], "v", "urn").collect()] == found


def test_risk_uses_doubles(spark):
    df = spark.createDataFrame([("patient_info", True), ("dosing", True), ("other", False), (None, None)], "l string, b boolean").select(ingest.risk_of(F.col("l"), F.col("b")).alias("r"))
    assert [r.r for r in df.collect()] == [0.65 + 0.05, 1.0, 0.5, 0.5]
    assert 0.65 + 0.05 >= dims.VERBATIM_RISK


@pytest.mark.parametrize(("codes", "code"), [(["C10", "C10AA", "C10AA05"], "C10AA"), (["C10"], "C10"), ([], "ZZZZ"), (None, "ZZZZ"), ([""], "ZZZZ")])
def test_class_code(spark, codes, code):
    assert spark.createDataFrame([(codes,)], "c array<string>").select(ingest.class_code(F.col("c")).alias("x")).first().x == code


def test_audit(spark):
    answers = spark.createDataFrame([(1, "Take 5 mg [SOURCE: urn:pharma:x]"), (2, "Take 5 mg. " + "y " * 300 + "[SOURCE: urn:pharma:z]"), (3, "nothing"), (4, None)], "answer_id int, text string")
    nodes = spark.createDataFrame([(1, "urn:pharma:x", "Take 5 mg", True), (1, "urn:pharma:y", "b", True), (2, "urn:pharma:x", "other words in this long node", True)], "answer_id int, urn_id string, verbatim_text string, verbatim_locked boolean")
    got = {r.answer_id: r for r in audit.audit(answers, nodes).collect()}
    assert got[1].verified == ["urn:pharma:x"] and got[1].missing == ["urn:pharma:y"] and got[1].orphaned == [] and got[1].passed
    assert got[2].hallucinated == ["urn:pharma:z"] and len(got[2].orphaned) == 1 and not got[2].passed
    assert got[3].passed and got[4].passed


def test_log_counts_repeats_once_but_documents_always(spark):
    log = spark.createDataFrame([("a", 5), ("a", 5)], "set_id string, n_docs long")
    assert tuple(ingest.log_totals(log).first()) == (1, 10)


def label(**sections):
    fields = ["dosage_and_administration", "dosage_and_administration_table", "warnings"]
    return tuple([f"set-{sections.get('n', 1)}", "20250131", (["Drugol"], ["brand one"]), None] + [sections.get(f) for f in fields])


RESULT = "set_id string, effective_time string, openfda struct<generic_name array<string>, brand_name array<string>>, boxed_warning array<string>, dosage_and_administration array<string>, dosage_and_administration_table array<string>, warnings array<string>"


def test_ingest_end_to_end_is_repeatable(spark):
    text = "<p>The recommended dose is 5 mg orally once daily for adults with a normal course of the illness.</p><p>Take 10 mg later in the week if it is needed.</p>"
    labels = spark.createDataFrame([("drugol", label(dosage_and_administration=[text, text])), ("lost", label(n=2))], f"name string, result struct<{RESULT}>")
    names = spark.createDataFrame([("drugol",), ("unknown",)], "name string")
    concepts = spark.createDataFrame([("drugol", "77")], "name string, rxcui string")
    classes = spark.createDataFrame([("77", ["C10", "C10AA"])], "rxcui string, codes array<string>")
    found = ingest.entities(ingest.resolve(names, concepts, classes, labels))
    one, two = (sorted(map(str, ingest.artifacts(found).collect())) for _ in range(2))
    assert one == two
    got = ingest.artifacts(found).orderBy("urn_id").collect()
    assert {r.atc_code for r in got} == {"C10AA"} and {r.drug_name_brand[0] for r in got} == {"Brand One"}
    parents = [r for r in got if r.layout_type == "dosing"]
    facts = [r for r in got if r.layout_type == "structured_fact"]
    assert parents and facts and {f.parent_urn for f in facts} <= {p.urn_id for p in parents}
    assert len({r.urn_id for r in got}) == len(got)
    assert ingest.artifacts(found.limit(0)).count() == 0


def test_table_section_replaces_prose(spark):
    rows = spark.createDataFrame([("s", label(dosage_and_administration=["prose"], dosage_and_administration_table=["table"]))], f"name string, result struct<{RESULT}>")
    assert [r.parts for r in ingest.sections(rows).collect()] == [["table"]]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    once = ingest.upsert(old, new, "k", [F.desc("v")])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 1)]
    assert sorted(map(tuple, ingest.upsert(once, new, "k", [F.desc("v")]).collect())) == sorted(map(tuple, once.collect()))


def test_prompt(spark):
    ev = spark.createDataFrame([("paraphrase", 1, "u<1>", "warning", None, "d", "a & b")], "section string, rank int, urn_id string, layout_type string, label_version_date string, drug_name_generic string, verbatim_text string")
    text = assemble.prompt(ev, "why?").first().prompt
    assert "u&lt;1&gt;" in text and "a &amp; b" in text and "NO verbatim-locked" in text and "<causal_mechanisms type" not in text


def test_prompt_is_as_written_by_hand(spark):
    columns = "section string, rank int, urn_id string, layout_type string, label_version_date string, drug_name_generic string, verbatim_text string, boxed_warning boolean, dose_values array<double>, dose_units array<string>, dose_route string, patient_population string, atc_code string, origin string"
    rows = [
        ("verbatim", 1, "u1", "dosing", "2025-01-01", "d'x", "5 mg & more", True, [5.0, 10.0], ["mg"], "oral", "", "C10AA", "pool"),
        ("verbatim", 2, "u2", "warning", None, "dx", "no doses", None, None, None, None, None, None, "pool"),
        ("paraphrase", 3, "u3", "pharmacology", "2024-01-01", "dx", "works", False, [], None, None, None, None, "class"),
        ("causal", 4, "u4", "interaction", None, "dx", "because", False, None, None, None, None, None, None),
        ("macro", 5, "u5", "cluster_summary", None, "dx", "class", False, None, None, None, None, "C10AA", None),
        ("tables", 6, "u6", "dosing", None, "dx", "| a |", False, None, None, None, None, None, None),
    ]
    conflicts = spark.createDataFrame([("d'x", "oral", "general", [5.0, 6.0], ["u1", "u2"], 0.2)], "drug string, route string, population string, values array<double>, urns array<string>, pct_diff double")
    got = assemble.prompt(spark.createDataFrame(rows, columns), "why <now>?", "causal", ["dx"], None, 2, conflicts).first().prompt
    want = "\n".join([
        "<system_directives>", *[x.format(dosed=1, rounds=2) for x in assemble.DIRECTIVES], "</system_directives>\n",
        "<query_intent>", "<type>CAUSAL</type>", "<target_drugs>dx</target_drugs>", "<target_population>general</target_population>", "</query_intent>\n",
        "<dose_conflict_warnings>", "  <conflict drug='d&#x27;x' route='oral' population='general'>Values found: [5.0, 6.0] (20% difference). Sources: u1, u2.</conflict>", "</dose_conflict_warnings>\n",
        "<clinical_evidence>", "  <verbatim_locked_nodes type='primary_dosing_and_warnings'>",
        "    <artifact urn='u1' type='dosing' boxed_warning='true' has_dose_metadata='true' temporal_anchor='2025-01-01'>", "      <drug>d&#x27;x</drug>", "      <context population='general' route='oral'/>",
        "      <dose_metadata values='[5.0, 10.0]' units='[&#x27;mg&#x27;]'/>", "      <exact_quote>5 mg &amp; more</exact_quote>", "    </artifact>",
        "    <artifact urn='u2' type='warning' boxed_warning='false' has_dose_metadata='false' temporal_anchor='unknown'>", "      <drug>dx</drug>", "      <context population='general' route='unspecified'/>",
        "      <exact_quote>no doses</exact_quote>", "    </artifact>", "  </verbatim_locked_nodes>\n", "  <supporting_nodes type='paraphrasable_context'>",
        "    <artifact urn='u3' type='pharmacology' scope='atc_class_level' temporal_anchor='2024-01-01'>      <content>works</content>    </artifact>", "  </supporting_nodes>\n",
        "  <causal_mechanisms type='drug_interactions'>", "    <artifact urn='u4' drug='dx'>      <mechanism_explanation>because</mechanism_explanation>    </artifact>", "  </causal_mechanisms>\n",
        "  <macro_context type='atc_class_summary'>", "    <artifact urn='u5' class='C10AA'>      <class_insight>class</class_insight>    </artifact>", "  </macro_context>\n",
        "  <structured_tables>", "    <artifact urn='u6'>      <table_data>| a |</table_data>    </artifact>", "  </structured_tables>\n", "</clinical_evidence>\n",
        "<reasoning_protocol>", *assemble.PROTOCOL, "</reasoning_protocol>\n", "<user_query>", "why &lt;now&gt;?", "</user_query>",
    ])
    assert got == want


def test_running_numbers_of_a_hot_key(spark):
    """One key with most rows: numbered like a window, but no partition holds it whole."""
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, concat('k', id % 7), 'hot') as k", "id * 7919 % 20000 as o").unionByName(spark.createDataFrame([(None, 5), (None, 3)], "k string, o long"))
    got = ingest.numbered(df, ["k"], [F.col("o")]).toPandas()
    assert len(got) == 20_002 and got[got["k"].isna()].sort_values("o")["seq"].tolist() == [0, 1]
    for _, own in got.groupby("k"):
        assert own.sort_values("o")["seq"].tolist() == list(range(len(own)))
    sizes = df.repartitionByRange(4, "k", "o").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() < 3 * sizes.median()


def test_conflicts_of_a_hot_group(spark):
    rows = spark.range(30_000).selectExpr("if(id % 2 = 0, 'hot', concat('g', id % 50)) as g", "array(cast(1 + id % 4 as double)) as v", "concat('u', id % 10) as u").unionByName(spark.createDataFrame([(None, [1.0], "x"), (None, [9.0], "y"), ("calm", [5.0], "z"), ("calm", [5.1], "z")], "g string, v array<double>, u string"))
    got = {r.g: r for r in assemble.conflicts(rows, ["g"], "v", "u").collect()}
    assert got["hot"].nodes == 15_000 and got["hot"]["values"] == [1.0, 3.0] and got["hot"].urns == ["u0", "u2", "u4", "u6", "u8"]
    assert got[None].urns == ["x", "y"] and "calm" not in got


def test_rewriting_sets_what_is_wanted():
    new, _ = reflect.rewritten(I.Intent("q", layouts=("warning",)), ["F3", "F5"], 1)
    assert new.wants_dosing and new.wants_interaction and new.wants_mechanism and new.preferred == "dosing"
    assert I.Intent("q", layouts=tuple("abcdef")).pools() == list("abcdef") and I.Intent("q", layouts=tuple("abcdef")).pools(4) == list("abcd")


def test_parents_and_neighbours(spark):
    index = spark.createDataFrame([(f"p{i}", None, f"A01B{i}", "dosing") for i in range(7)], "urn_id string, parent_urn string, atc_code string, layout_type string")
    hits = spark.createDataFrame([(f"h{i}", f"p{i // 2}", i) for i in range(14)], "urn_id string, parent_urn string, rank int")
    assert sorted(r.urn_id for r in assemble.parents(hits, index).collect()) == ["p0", "p1", "p2", "p3", "p4"]
    codes = spark.createDataFrame([("A01BZ",), ("A01",), (None,)], "atc_code string")
    assert assemble.class_neighbours(index, codes, "dosing").count() == 7
