"""Entities of a sentence: route, population and doses, with negated mentions left out.

Negation is decided by the published rule of trigger words: a mention that follows ``no``, ``not``,
``without``, ``denies`` and the like within five words of the same clause does not count, nor one after ``history of``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import dims
from quillspark.functions.text import quoted

_NEGATION = r"(?<![\p{L}\p{N}])(?:no|not|never|without|denies|denied|negative for|history of|previous)\s+"


def affirmed(text: Column, mention: str) -> Column:
    """The text without the mentions (a pattern) that are negated or of the past."""
    return F.regexp_replace(text, rf"(?i){_NEGATION}(?:[^\s.;:!?]+\s+){{0,5}}(?:{mention})", " ")


def last_label(text: Column, vocabulary: list[tuple[str, list[str]]], default: str) -> Column:
    """The label of the last mention that is not negated.

    One expression cuts negated mentions out, a second finds the last keyword that is left.
    """
    label = {w.strip(): name for name, words in vocabulary for w in words}
    either = "|".join(quoted(w) for w in sorted(label, key=lambda w: (-len(w), w)))
    positive = affirmed(F.lower(text), either)
    last = F.regexp_extract(positive, rf"(?s)^.*(?<![\p{{L}}\p{{N}}])({either})", 1)
    named = F.create_map(*[F.lit(x) for pair in label.items() for x in pair])
    return F.coalesce(F.try_element_at(named, last), F.lit(default))


_UNITS = "mg/kg|mg/m2|mg/m²|mcg/kg|mcg/day|mcg/ml|mg/day|mg/ml|units/kg|unit/kg|mg|mcg|g|meq|ml|units|iu"
_FACT = rf"(?i)(?<![\p{{L}}\p{{N}}.,])(\d+(?:\.\d+)?)\s*({_UNITS})(?![\p{{L}}\p{{N}}/²])"


def dose_values(text: Column) -> Column:
    """Distinct values that are not negated, in order of mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(affirmed(text, _FACT), F.lit(_FACT), F.lit(1)), lambda x: x.try_cast("double")))


def dose_units(text: Column) -> Column:
    """Distinct units in lower case, sorted; units of laboratory values are excluded."""
    units = F.transform(F.regexp_extract_all(affirmed(text, _FACT), F.lit(_FACT), F.lit(2)), F.lower)
    return F.array_sort(F.array_distinct(F.filter(units, lambda u: ~u.isin(dims.LAB_UNITS))))


def route(text: Column) -> Column:
    return last_label(text, dims.ROUTES, "unspecified")


def population(text: Column) -> Column:
    return last_label(text, dims.POPULATIONS, "general")
