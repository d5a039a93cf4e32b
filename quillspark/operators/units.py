"""Problem 3: amounts recorded in different units, brought to the common unit of their kind.

Pure SQL: number and unit are taken from the text by regular expressions, the spelling of the unit
is normalised by joins with two alias tables, and the unit is the first there is of the text's, the
unit field's and (if given) the source's default; then ``amount = value * factor + offset``.

The text's unit of a number is, in this order, the one next to it, the one at the end of the range
or enumeration it belongs to (however long), or the last one announced before it (``in mg``, ``(mg)``). A number counted
in forms (tablets, puffs) has a unit that converts to nothing. Numbers are read with decimal points or commas and
grouped thousands; ``1.500`` may match 1.5 or 1500, but ``1,500`` is 1500. Values take the mentions with a unit in the
order of the text: each the first of its number after the one before it took, or else the first of its number.

Defined results: null and NaN entries, null arrays, entries too large for a bigint, and entries without a unit or with an unknown one give
no row. Null or empty texts leave the unit field. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spelling, the unit it stands for, factor to the common unit of its kind.
BASES = [
    ("ng", "mcg", 0.001), ("nanogram", "mcg", 0.001), ("nanogramme", "mcg", 0.001),
    ("mcg", "mcg", 1.0), ("µg", "mcg", 1.0), ("μg", "mcg", 1.0), ("ug", "mcg", 1.0), ("microgram", "mcg", 1.0), ("microgramme", "mcg", 1.0),
    ("mg", "mcg", 1e3), ("milligram", "mcg", 1e3), ("milligramme", "mcg", 1e3),
    ("g", "mcg", 1e6), ("gm", "mcg", 1e6), ("gram", "mcg", 1e6), ("gramme", "mcg", 1e6),
    ("ml", "ml", 1.0), ("cc", "ml", 1.0), ("milliliter", "ml", 1.0), ("millilitre", "ml", 1.0),
    ("l", "ml", 1e3), ("liter", "ml", 1e3), ("litre", "ml", 1e3),
    ("u", "unit", 1.0), ("iu", "unit", 1.0), ("i.u.", "unit", 1.0), ("unit", "unit", 1.0), ("international unit", "unit", 1.0),
    ("million u", "unit", 1e6), ("million iu", "unit", 1e6), ("million unit", "unit", 1e6), ("million international unit", "unit", 1e6),
    ("meq", "meq", 1.0), ("milliequivalent", "meq", 1.0),
]
#: Spelling after "per", the unit it stands for, factor (per minute is 60 per hour).
DIVISORS = [
    ("kg", "kg", 1.0), ("kilogram", "kg", 1.0), ("kilogramme", "kg", 1.0), ("kilo", "kg", 1.0),
    ("m2", "m2", 1.0), ("m²", "m2", 1.0), ("m^2", "m2", 1.0), ("square metre", "m2", 1.0), ("square meter", "m2", 1.0),
    ("ml", "ml", 1.0), ("cc", "ml", 1.0), ("milliliter", "ml", 1.0), ("millilitre", "ml", 1.0),
    ("h", "h", 1.0), ("hr", "h", 1.0), ("hour", "h", 1.0), ("min", "h", 60.0), ("minute", "h", 60.0),
]
#: The kinds of amounts that are known: base, divisor, common unit.
KINDS = [("mcg", "", "mcg"), ("mcg", "kg", "mcg/kg"), ("mcg", "m2", "mcg/m2"), ("mcg", "ml", "mcg/ml"), ("mcg", "h", "mcg/h"), ("ml", "", "ml"), ("unit", "", "unit"), ("unit", "kg", "unit/kg"), ("meq", "", "meq")]
#: Counted forms: a number of these is no amount.
FORMS = "tablet capsule puff spray sachet drop lozenge patch suppository vial ampoule pill caplet inhalation actuation pessary spoonful".split()

_SPACE = r"[\s\u00a0\u202f]"
_NUMBER = r"(?:\d{1,3}(?:[,.\u00a0\u202f'’]\d{3}){1,8}(?:[.,]\d+)?|\d+(?:[.,]\d+)?|[.,]\d+)(?![\d]|[.,]\d)"
_FREE = r"(?<![\p{L}\p{N}])(?<!\p{N}[.,])"


def _either(spellings: list[str]) -> str:
    longest_first = sorted(spellings, key=lambda s: (-len(s), s))
    return "|".join(s.replace(".", r"\.").replace("^", r"\^").replace(" ", _SPACE + "+") + ("s?" if s[-1].isalpha() else "") for s in longest_first)


_AMOUNT = rf"(?:{_either([b for b, _, _ in BASES])})(?:(?:{_SPACE}*/{_SPACE}*|{_SPACE}+per{_SPACE}+)(?:{_either([d for d, _, _ in DIVISORS])}))?"
_END = rf"(?![\p{{L}}\p{{N}}²])(?!{_SPACE}*/|{_SPACE}+per{_SPACE}+(?:dl|l|decilit|lit))"
_UNIT = rf"(?:{_AMOUNT}|(?:{'|'.join(FORMS)})(?:e?s)?|suppositories|pessaries){_END}"
_NEXT = rf"(?:{_SPACE}*-?{_SPACE}*({_UNIT}))"
_ON = rf"({_SPACE}*(?:[-–—/,]|,?{_SPACE}*(?:to|and|or)){_SPACE}*{_NUMBER})"
#: An announced unit; or a number, its own unit, and what links it to the next number.
MENTION = rf"(?iu)(?:\bin{_SPACE}+|\({_SPACE}*)({_AMOUNT}{_END})|{_FREE}({_NUMBER})(?={_NEXT})?(?={_ON})?"
_POINT = r"^(\\d{1,3}([,\\u00a0\\u202f\'’]\\d{3})*(\\.\\d+)?|\\d+(\\.\\d+)?|\\.\\d+)$"
#: With exactly three digits behind it, a comma groups thousands.
_COMMA = r"(?!^[1-9]\\d{0,2},\\d{3}$)^(\\d{1,3}([.\\u00a0\\u202f\'’]\\d{3})*(,\\d+)?|\\d+(,\\d+)?|,\\d+)$"


def alias_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``base, kind, common_unit, factor`` by spelling and divisor spelling; both small and fixed."""
    several = lambda rows: {(s + e, u, f) for s, u, f in rows for e in ("", "s")}
    bases = spark.createDataFrame(sorted(several(BASES)), "base string, base_unit string, base_factor double")
    divisors = spark.createDataFrame([("", "", 1.0), *sorted(several(DIVISORS))], "divisor string, divisor_unit string, divisor_factor double")
    return bases, divisors


def normal_unit(unit: str) -> tuple[str, str]:
    """SQL for the base and the divisor of the unit text in the SQL expression ``unit``."""
    flat = rf"regexp_replace(regexp_replace(lower(trim({unit})), '[\\s\\u00a0\\u202f]+', ' '), ' ?/ ?| per ', '/')"
    return f"split({flat}, '/', 2)[0]", f"coalesce(get(split({flat}, '/', 2), 1), '')"


def common_units(
    df: DataFrame, id_col: str = "row_id", values_col: str = "dose_values", units_col: str = "dose_units", text_col: str = "verbatim_text", source_col: str | None = None, defaults: dict[str, str] | None = None
) -> DataFrame:
    """``row_id, pos, unit, amount``: every recorded value in thousandths of the common unit of its kind.

    ``defaults`` names the unit of each source (a value of ``source_col``) where neither text nor field has one.
    """
    spark = df.sparkSession
    source = F.col(source_col) if source_col else F.lit(None).cast("string")
    rows = df.where(F.size(values_col) > 0).select(
        F.col(id_col).alias("row_id"), F.col(values_col).alias("vals"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), source.alias("source"),
        F.when(F.size(units_col) == 1, F.get(units_col, F.lit(0))).alias("field_unit"),
    )
    found = [F.regexp_extract_all("text", F.lit(MENTION), F.lit(k)) for k in (1, 2, 3, 4)]
    rows = rows.withColumns(dict(zip(("said", "numbers", "own", "link"), found)))
    readings = rf"""
        transform(numbers, n -> named_struct(
            'point', if(n rlike '{_POINT}', try_cast(regexp_replace(n, '[^0-9.]', '') as double), null),
            'comma', if(n rlike '{_COMMA}', try_cast(replace(regexp_replace(n, '[^0-9,]', ''), ',', '.') as double), null)))"""
    # A run of linked numbers ends with the first that has a unit, and all of it takes that; an announcement holds up to the
    # next one. Both are cut out of one joined string, so that the work is linear in the number of mentions.
    runs = r"split(array_join(transform(own, (u, i) -> concat(u, if(u <> '' or link[i] = '', '\u0002', '\u0001'))), ''), '\u0002')"
    listed = rf"flatten(transform({runs}, r -> array_repeat(substring_index(r, '\u0001', -1), length(r) - length(replace(r, '\u0001', '')) + 1)))"
    parts = r"split(array_join(transform(said, u -> if(u <> '', concat('\u0002', u, '\u0001'), '\u0001')), ''), '\u0002')"
    told = rf"flatten(transform({parts}, r -> array_repeat(substring_index(r, '\u0001', 1), length(r) - length(replace(r, '\u0001', '')))))"
    places = "transform(vals, v -> filter(sequence(0, size(numbers) - 1), i -> units[i] <> '' and (abs(readings[i].point - v) <= 1e-9 * abs(v) or abs(readings[i].comma - v) <= 1e-9 * abs(v))))"
    with_units = "transform(places, p -> transform(p, i -> named_struct('at', i, 'unit', units[i])))"
    step = "(s, c) -> named_struct('at', coalesce(get(filter(c, m -> m.at > s.at), 0).at, get(c, 0).at, s.at), 'units', array_append(s.units, coalesce(get(filter(c, m -> m.at > s.at), 0).unit, get(c, 0).unit)))"
    rows = rows.withColumns({"readings": F.expr(readings), "listed": F.expr(listed), "told": F.expr(told)})
    rows = rows.withColumn("units", F.expr("transform(said, (x, i) -> coalesce(nullif(listed[i], ''), told[i]))"))
    rows = rows.withColumn("places", F.when(F.size("numbers") > 0, F.expr(places)))
    rows = rows.withColumn("mentioned", F.expr(with_units))
    rows = rows.withColumn("text_units", F.expr(f"aggregate(mentioned, named_struct('at', -1, 'units', cast(array() as array<string>)), {step}).units"))
    each = rows.selectExpr("field_unit", "source", "row_id", "text_units", "posexplode(vals) as (pos, value)").where("value is not null and not isnan(value)")
    same, text_unit = each, "get(text_units, pos)"
    default = "cast(null as string)"
    if defaults:
        same = same.join(F.broadcast(spark.createDataFrame(sorted(defaults.items()), "source string, default_unit string")), "source", "left")
        default = "default_unit"
    base, divisor = normal_unit("chosen")
    chosen = same.withColumn("chosen", F.expr(f"coalesce({text_unit}, field_unit, {default})")).selectExpr("row_id", "pos", "value", f"{base} as base", f"{divisor} as divisor")
    bases, divisors = alias_tables(spark)
    kinds = spark.createDataFrame(KINDS, "base_unit string, divisor_unit string, unit string").withColumn("offset", F.lit(0.0))
    known = chosen.join(F.broadcast(bases), "base").join(F.broadcast(divisors), "divisor").join(F.broadcast(kinds), ["base_unit", "divisor_unit"])
    return known.selectExpr("row_id", "cast(pos as bigint) as pos", "unit", "try_cast(round((value * base_factor * divisor_factor + offset) * 1000) as bigint) as amount").where("amount is not null")
