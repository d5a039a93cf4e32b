import pytest

from quillspark.operators.units import common_units

SCHEMA = "row_id long, verbatim_text string, dose_values array<double>, dose_units array<string>, unit string, source string"


def convert(spark, text, values, units=None, **options):
    df = spark.createDataFrame([(1, text, values, units, "x", "here")], SCHEMA)
    return {r.pos: (r.unit, r.amount) for r in common_units(df, **options).collect()}


@pytest.mark.parametrize(
    ("text", "values", "units", "expected"),
    [
        ("Give 2,5 µg with food.", [2.5], ["mg"], {0: ("mcg", 2500)}),
        ("Give 1\u00a0500 milligrams per square metre daily", [1500.0], None, {0: ("mcg/m2", 1_500_000_000)}),
        ("Give 1,000 mg now", [1000.0], [], {0: ("mcg", 1_000_000_000)}),
        ("Start at between 250 and 800 nanograms", [250.0, 800.0], None, {0: ("mcg", 250), 1: ("mcg", 800)}),
        ("Take 5-7.5 milligram", [5.0, 7.5], None, {0: ("mcg", 5_000_000), 1: ("mcg", 7_500_000)}),
        ("Dose (mg) in x: 10 at night; 15 later", [10.0, 15.0], None, {0: ("mcg", 10_000_000), 1: ("mcg", 15_000_000)}),
        ("All strengths are given in mg per kg. Take 2.5 daily. Glucose above 2 mg/dL", [2.5], ["mcg"], {0: ("mcg/kg", 2_500_000)}),
        ("Start at 500-μg twice daily", [0.5], ["milligram"], {0: ("mcg", 500_000)}),
        ("Start at 4 puffs each morning", [4.0], ["mg"], {}),
        ("the dose is 1.25 mcg/min", [1.25], None, {0: ("mcg/h", 75_000)}),
        ("give 1.2 million IU", [1.2], None, {0: ("unit", 1_200_000_000)}),
        ("give 100 ΜG PER SQUARE METRE", [100.0], None, {0: ("mcg/m2", 100_000)}),
        ("glucose above 76 mg/dL", [76.0], ["mg", "g"], {}),
        ("Doses of 1, 2, 3, 4, 5 and 6 mg", [1.0, 6.0], None, {0: ("mcg", 1_000_000), 1: ("mcg", 6_000_000)}),
        ("Doses of 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, or 12 mg", [1.0, 7.0], ["ml"], {0: ("mcg", 1_000_000), 1: ("mcg", 7_000_000)}),
        ("Doses in mg: 5 and 6. Volumes in ml: 7 and 8.", [5.0, 6.0, 7.0, 8.0], None, {0: ("mcg", 5_000_000), 1: ("mcg", 6_000_000), 2: ("ml", 7000), 3: ("ml", 8000)}),
        ("5 mg first, then 5 ml", [5.0, 5.0], None, {0: ("mcg", 5_000_000), 1: ("ml", 5000)}),
        ("10 ml of water with 5 mg, then 10 mg", [5.0, 10.0], None, {0: ("mcg", 5_000_000), 1: ("mcg", 10_000_000)}),
        ("10 mg with 5 ml", [5.0, 10.0], None, {0: ("ml", 5000), 1: ("mcg", 10_000_000)}),
        ("Take 1,250 mg", [1.25], ["grams"], {0: ("mcg", 1_250_000_000)}),
        ("Take 0,125 mg", [0.125], None, {0: ("mcg", 125_000)}),
        ("Take 1.250 mg", [1.25], None, {0: ("mcg", 1_250_000)}),
        ("1, 2 tablets and 3 mg", [1.0, 3.0], ["mg"], {1: ("mcg", 3_000_000)}),
        ("no numbers", [1.0], ["mg"], {0: ("mcg", 1_000_000)}),
        (None, [5.0], ["cc"], {0: ("ml", 5000)}),
        ("", [5.0, None], ["MEQ"], {0: ("meq", 5000)}),
        ("5 mg", [None, float("nan")], ["mg"], {}),
        ("5 mg", None, ["mg"], {}),
        ("5 mg", [], None, {}),
        ("5 xyz", [5.0], ["xyz"], {}),
        ("x", [1e300], ["g"], {}),
    ],
)
def test_amounts(spark, text, values, units, expected):
    assert convert(spark, text, values, units) == expected


def test_source_default_comes_last(spark):
    assert convert(spark, "5", [5.0], None, source_col="source", defaults={"here": "mg"}) == {0: ("mcg", 5_000_000)}
    assert convert(spark, "5", [5.0], ["g"], source_col="source", defaults={"here": "mg"}) == {0: ("mcg", 5_000_000_000)}


def test_empty_table_and_repeated_rows(spark):
    assert common_units(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = spark.createDataFrame([(1, "5 mg", [5.0], None, None, None)] * 2, SCHEMA)
    assert common_units(twice).count() == 2


def test_very_long_text(spark):
    assert convert(spark, "word " * 200_000 + "5 mg", [5.0]) == {0: ("mcg", 5_000_000)}
    assert convert(spark, "7, " * 100_000 + "5 mg", [5.0, 7.0]) == {0: ("mcg", 5_000_000), 1: ("mcg", 7_000_000)}
