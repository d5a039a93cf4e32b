"""Questions to intents, by ordered rules: at plan time for one question, as columns for a table of them.

``parity=True`` keeps substring triggers (``and`` inside ``standard``); by default words and phrases match whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import dims
from quillspark.functions import text as T


@dataclass(frozen=True)
class Intent:
    question: str
    query_type: str = "factual"
    layouts: tuple[str, ...] = tuple(dims.DEFAULT_LAYOUTS)
    population: str | None = None
    drugs: tuple[str, ...] = ()
    wants_interaction: bool = False
    wants_dosing: bool = False
    wants_mechanism: bool = False
    date_from: str | None = None
    date_to: str | None = None
    explicit_years: bool = False
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def preferred(self) -> str:
        return self.layouts[0]

    def pools(self, most: int | None = None) -> list[str]:
        """The layouts to search: all (or the first ``most``), then interaction and pharmacology when wanted."""
        extra = [x for x, on in (("interaction", self.wants_interaction), ("pharmacology", self.wants_mechanism)) if on and x not in self.layouts]
        return [*self.layouts[:most], *extra]

    def with_(self, **changes: object) -> Intent:
        return replace(self, **changes)


def _has(text: str, phrase: str, parity: bool) -> bool:
    return phrase in text if parity else re.search(rf"(?<![^\W_]){re.escape(phrase)}s?(?![^\W_])", text) is not None


# Words that begin questions; a capital letter does not make them names.
QUESTION_WORDS = frozenset("what when where which who whom whose why how does should could would can is are the this that give list show tell compare".split())


def drug_names(question: str, dictionary: set[str], parity: bool = False, most: int = 2) -> tuple[str, ...]:
    """Names of the dictionary, longest first at each place, in order; else the first capitalised words."""
    names = sorted({n.strip().lower() for n in dictionary if n and n.strip()}, key=lambda n: (-len(n), n))
    if names:
        found = re.findall(r"\b(?:" + "|".join(map(re.escape, names)) + r")\b", question.lower())
        if found:
            return tuple(dict.fromkeys(found))
    words = [w.lower() for w in re.findall(r"\b[A-Z][a-z]{3,}(?:-[A-Z][a-z]+)?\b", question)]
    return tuple([w for w in words if parity or w not in QUESTION_WORDS][:most])


def intent_of(question: str, dictionary: set[str] = frozenset(), year: int = 2026, parity: bool = False) -> Intent:
    """The intent of one question. ``year`` is the current year, given so that results can be repeated."""
    low = question.lower()
    spaced = set(low.split())
    signalled = lambda words: bool(spaced & set(words)) if parity else any(_has(low, w, False) for w in words)
    query_type = next((name for name, words in dims.SIGNALS if signalled(words) or (name == "causal" and _has(low, "why", parity))), "factual")
    hits = [(layout, pop) for phrase, layout, pop in dims.CONCEPTS if _has(low, phrase, parity)]
    layouts = tuple(dict.fromkeys(x for x, _ in hits)) or tuple(dims.DEFAULT_LAYOUTS)
    population = next((p for _, p in hits if p), None)
    for pattern, label in dims.POPULATION_PATTERNS:
        bounded = pattern if parity else rf"(?<![^\W_])(?:{pattern})" + (r"s?(?![^\W_])" if label == "pediatric" else r"")
        if re.search(bounded, low):
            population = label
            break
    paired = any(_has(low, w, parity) for w in dims.PAIRING_WORDS)
    found = [int(y) for y in re.findall(r"\b(20\d{2})\b" if parity else r"\b(20\d{2})\b(?!\s*(?:mg|mcg|g|ml|meq|iu|units?|kg)\b)", low)]
    return Intent(
        question=question, query_type=query_type, layouts=layouts, population=population, drugs=drug_names(question, dictionary, parity),
        wants_interaction=query_type == "causal" or "interaction" in layouts[0] or paired, wants_dosing="dosing" in layouts,
        wants_mechanism="pharmacology" in layouts or query_type == "causal", explicit_years=bool(found),
        date_from=f"{min(found, default=year - 5)}-01-01", date_to=f"{max(found, default=year)}-12-31",
    )


def name_dictionary(index: DataFrame, most: int = 1000, longest: int = 256, configured: Iterable[str] = ()) -> set[str]:
    """Generic and brand names, the ``most`` frequent of each, and the configured ones; at most twice ``most`` names reach the driver."""
    generic = top_terms(index.select(F.lower(F.trim("drug_name_generic")).alias("name")), most, longest)
    brand = top_terms(index.select(F.explode("drug_name_brand").alias("name")).select(F.lower(F.trim("name")).alias("name")), most, longest)
    own = {n.strip().lower() for n in configured if n and n.strip()}
    return own | {r.name for r in generic.unionByName(brand).select("name").distinct().collect()}


def top_terms(names: DataFrame, most: int = 1000, longest: int = 256) -> DataFrame:
    """``name, n``: the most frequent values, ties by name; nulls, blanks and over-long values are left out."""
    return names.where((F.length("name") > 0) & (F.length("name") <= longest)).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)


def type_column(question: Column) -> Column:
    """The question type for a table of questions; signals match as whole words or phrases."""
    low, out = F.concat(F.lit(" "), F.array_join(T.tokens(question), " "), F.lit(" ")), None
    for name, words in dims.SIGNALS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(f" {' '.join(re.split('[^a-z0-9]+', w))} ")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("factual")


def layouts_column(question: Column) -> Column:
    """Distinct layouts in order of the concept table, or the default ones."""
    low = F.concat(F.lit(" "), F.array_join(T.tokens(question), " "), F.lit(" "))
    found = F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(f" {p} "), F.lit(layout)) for p, layout, _ in dims.CONCEPTS])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, dims.DEFAULT_LAYOUTS)))
