import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import html
from quillspark.functions import text as T
from quillspark.operators import facts


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_normalise_dosing(spark):
    assert one(spark, "Adults: Take 5 mg  daily • Max 10 mg", T.normalise_dosing) == "Adults. Take 5 mg daily. Max 10 mg"


def test_packing_keeps_one_sentence_of_overlap(spark):
    text = "Aaaa bbbb. Cccc dddd. Eeee ffff."
    assert one(spark, text, lambda x: T.chunks(x, 20)) == ["Aaaa bbbb.", "Aaaa bbbb. Cccc dddd.", "Cccc dddd. Eeee ffff."]
    assert one(spark, text, lambda x: T.chunks(x, 100)) == [text]


@pytest.mark.parametrize(("text", "value", "unit"), [("10.5 MG/KG daily", 10.5, "mg/kg"), ("take 2 gummies", 2.0, "g"), ("none", None, None), ("", None, None), (None, None, None)])
def test_dose(spark, text, value, unit):
    assert one(spark, text, T.dose_value) == value
    assert one(spark, text, T.dose_unit) == unit


def test_merge_after_colon(spark):
    assert one(spark, ["Note:", "X.", "Y."], T.merge_after_colon, "array<string>") == ["Note: X.", "Y."]
    assert one(spark, [], T.merge_after_colon, "array<string>") == []


def test_ngrams(spark):
    assert one(spark, "a b c d e".split(), lambda x: T.ngrams(x, 4), "array<string>") == ["a b c d", "b c d e"]
    assert one(spark, ["a", "b"], lambda x: T.ngrams(x, 4), "array<string>") == []


def test_urns(spark):
    lit = F.lit
    row = spark.range(1).select(
        T.artifact_urn(lit("fda_us"), lit("123"), lit("4a2bad30-e7cf-1"), lit("dosing"), lit(7)).alias("a"), T.artifact_urn(lit("fda_us"), lit("123"), lit("4a2bad30-e7cf-1"), lit("dosing"), lit(12345)).alias("b"),
        T.fact_urn(lit("1"), lit("4a2bad30-e"), lit(None).cast("string"), lit("older adult"), lit(3), lit("")).alias("c"),
    ).first()
    assert row.a == "urn:pharma:fda_us:123:4a2bad30:dosing:0007"
    assert row.b.endswith(":12345")
    assert row.c == "urn:pharma:fda_us:1:4a2bad30:dosing_fact:unspecified:older_adult:0003:000000"


@pytest.mark.parametrize(("text", "fixed", "parity"), [("dose in kidney disease", "renal_impairment", "pediatric"), ("dose for a child", "pediatric", "pediatric"), ("plain", None, None)])
def test_population_asked(spark, text, fixed, parity):
    assert one(spark, text, T.population_asked) == fixed
    assert one(spark, text, lambda x: T.population_asked(x, parity=True)) == parity


def test_dose_sentence_stems(spark):
    s = "They were titrated to 20 mg over several weeks"
    assert one(spark, s, T.is_dose_sentence) is True
    assert one(spark, s, lambda x: T.is_dose_sentence(x, parity=True)) is False


def test_facts_leave_out_negated_mentions(spark):
    text = "Take 5 mg orally, 10 mg later, not intravenous. Serum glucose 80 mg/dL."
    assert one(spark, text, facts.dose_values) == [5.0, 10.0]
    assert one(spark, text, facts.dose_units) == ["mg"]
    assert one(spark, text, facts.route) == "oral"
    assert one(spark, text, facts.population) == "general"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>A</p><ul><li>x</li></ul>", "A\n* x"),
        ("<table><tr><th>Dose</th><th>Unit</th></tr><tr><td>5</td><td>mg</td></tr></table>", "| Dose | Unit |\n| --- | --- |\n| 5 | mg |"),
        ("<table><tr><td colspan=2>A</td></tr></table>", "| col_1 | col_2 |\n| --- | --- |\n| A | |"),
        ("a<script>b()</script>c &amp; d", "a c & d"),
        ("<b", "<b"),
        ("", ""),
    ],
)
def test_html(source, text):
    assert html.render(source) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ptdrhlai =\"'&;|\n x1", max_size=60))
def test_html_never_fails(source):
    assert "\n\n" not in html.render(source)


def test_escape(spark):
    assert one(spark, "<a & 'b'>\"", T.escape_markup) == "&lt;a &amp; &#x27;b&#x27;&gt;&quot;"


def test_context_window(spark):
    assert one(spark, "0123456789", lambda x: T.context_window(x, F.lit("5"), 2)) == "3456"
    assert one(spark, "0123456789", lambda x: T.context_window(x, F.lit("x"), 2)) == ""


def test_chunks_of_long_texts_and_overlaps(spark):
    """Packing against a plain loop, for several overlaps, and in linear time."""
    import random
    import time

    def plain(parts, limit, overlap):
        done, held, n = [], [], 0
        for x in parts:
            if n + len(x) > limit and held:
                done.append(" ".join(held))
                held = held[-overlap:] if overlap else []
                n = sum(len(h) + 1 for h in held)
            held, n = [*held, x], n + len(x) + 1
        return done + ([" ".join(held)] if held else [])

    r = random.Random(1)
    rows = [(["x" * r.randint(0, 30) for _ in range(r.randint(0, 25))],) for _ in range(100)]
    df = spark.createDataFrame(rows, "p array<string>")
    for overlap in (0, 1, 3):
        got = df.select("p", T.pack_sentences(F.col("p"), 60, overlap).alias("c")).collect()
        assert all(x.c == plain(x.p, 60, overlap) for x in got)
    began = time.time()
    text = "A sentence of some words. " * 60_000 + "Note:\n" + "And more of it. " * 1000
    assert spark.createDataFrame([(text,)], "t string").select(F.size(T.chunks(F.col("t"))).alias("n")).first().n > 1500
    assert time.time() - began < 60
