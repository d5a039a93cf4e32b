"""Text functions as Column expressions; all run on the JVM.

Nulls give null (or an empty array where that is said); no function raises on any text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import dims

NOT_WORD = r"[^\p{L}\p{N}]+"


def quoted(text: str) -> str:
    """``text`` as a regular expression that Java reads literally."""
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", text)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda x: x != "")


def folded_tokens(text: Column) -> Column:
    """Tokens of names, with common Latin accents folded."""
    return tokens(F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))


def sentences(text: Column) -> Column:
    """The text cut where white space follows ``.``, ``!`` or ``?``."""
    return F.split(text, r"(?<=[.!?])\s+")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_lines(text: Column) -> Column:
    """Blank runs collapsed within lines, empty lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalise_dosing(text: Column) -> Column:
    """Bullets become sentence ends, ``word: Capital`` too; runs of white space become one space."""
    bullets = F.regexp_replace(text, r"\s*[•·▪▸]\s*", ". ")
    heads = F.regexp_replace(bullets, r"([A-Za-z)]):(\s+[A-Z])", "$1.$2")
    return F.trim(F.regexp_replace(heads, r"\s{2,}", " "))


_DOSE = rf"(?i)(\d+\.?\d*)\s*({'|'.join(dims.DOSE_UNITS)})"


def dose_value(text: Column) -> Column:
    """The first number that a dose unit follows, else null."""
    return F.regexp_extract(text, _DOSE, 1).try_cast("double")


def dose_unit(text: Column) -> Column:
    """The unit of ``dose_value`` in lower case, else null."""
    unit = F.lower(F.regexp_extract(text, _DOSE, 2))
    return F.when(unit != "", unit)


def first_label(text: Column, vocabulary: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The first label of which a keyword occurs in the text (ignoring case)."""
    low, out = F.lower(text), None
    for label, words in vocabulary:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default)) if default else out


def route_of(text: Column) -> Column:
    return first_label(text, dims.ROUTES)


def population_of(text: Column) -> Column:
    return first_label(text, dims.POPULATIONS, "general")


def population_asked(question: Column, parity: bool = False) -> Column:
    """The population a question is about. ``parity``: patterns match inside words, as they stand."""
    out = None
    for pattern, label in dims.POPULATION_PATTERNS:
        hit = question.rlike(f"(?i){pattern}") if parity else question.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{pattern})\p{{L}}*" if label != "pediatric" else rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{pattern})s?(?![\p{{L}}\p{{N}}])")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by spaces; empty when there are fewer words.

    ``words`` should be a column, not an expression: it is read once per run.
    """
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def tokens_by_space(text: Column) -> Column:
    """Words as white space separates them."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def context_window(text: Column, needle: Column, window: int = 300) -> Column:
    """The text from ``window`` characters before the first occurrence to ``window`` after its start; empty if absent."""
    at = F.instr(text, needle)
    start = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + window - start)).otherwise(F.lit(""))


def expand_abbreviations(text: Column) -> Column:
    for short, long in dims.ABBREVIATIONS:
        text = F.regexp_replace(text, rf"(?i)\b{short}\b", long)
    return text


def escape_markup(text: Column) -> Column:
    """``& < > " '`` as entities, ``&`` first."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def artifact_urn(source: Column, rxcui: Column, set_id: Column, layout: Column, seq: Column) -> Column:
    return F.format_string("urn:pharma:%s:%s:%s:%s:%04d", source, rxcui, F.substring(F.replace(set_id, F.lit("-")), 1, 8), layout, seq)


def fingerprint(text: Column) -> Column:
    """Six hexadecimal digits of the first 80 characters, the same in every run."""
    return F.substring(F.sha2(F.substring(text, 1, 80), 256), 1, 6)


def fact_urn(rxcui: Column, set_id: Column, route: Column, population: Column, seq: Column, text: Column) -> Column:
    slug = lambda x, default: F.replace(F.coalesce(x, F.lit(default)), F.lit(" "), F.lit("_"))
    print_of = F.when(F.coalesce(text, F.lit("")) == "", "000000").otherwise(fingerprint(text))
    return F.format_string("urn:pharma:fda_us:%s:%s:dosing_fact:%s:%s:%04d:%s", rxcui, F.substring(F.replace(set_id, F.lit("-")), 1, 8), slug(route, "unspecified"), slug(population, "general"), seq, print_of)


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(F.struct(value.alias("v"))), lambda s: use(s["v"])), F.lit(0))


def merge_after_colon(parts: Column, glue: str = " ") -> Column:
    """Each part that follows one ending in ``:`` is joined to it; linear in the parts. ``\\u0003`` separates parts."""

    def merged(v: Column) -> Column:
        joined = F.transform(v, lambda x, i: F.concat(x, F.when(i == F.size(v) - 1, "").when(F.rtrim(x).endswith(":"), glue).otherwise("\u0003")))
        return F.when(F.size(v) > 0, F.split(F.array_join(joined, ""), "\u0003")).otherwise(F.array().cast("array<string>"))

    return with_value(parts, merged)


def pack_sentences(parts: Column, limit: int = dims.MAX_CHUNK, overlap: int = 1) -> Column:
    """Greedy packing: a chunk is flushed before it would exceed ``limit`` and its last ``overlap`` parts begin the next.

    Only the bounds of chunks are gathered on the way (``lo`` to ``i`` is what is held, ``tail`` the lengths of its last
    parts), so the work is linear in the parts.
    """
    bounds = F.array().cast("array<struct<lo: int, hi: int>>")
    zero = F.struct(bounds.alias("bounds"), F.lit(1).alias("lo"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("tail"))

    def step(acc: Column, x: Column) -> Column:
        size, held = F.length(x), acc["i"] >= acc["lo"]
        full = (acc["n"] + size > limit) & held
        kept = F.slice(acc["tail"], F.greatest(F.size(acc["tail"]) - (overlap - 1), F.lit(1)), overlap) if overlap else F.array().cast("array<int>")
        tail = F.when(full, kept).otherwise(acc["tail"])
        kept_n = F.aggregate(kept, F.lit(0), lambda n, k: n + k + 1)
        longer = F.array_append(tail, size)
        return F.struct(
            F.when(full, F.array_append(acc["bounds"], F.struct(acc["lo"].alias("lo"), acc["i"].alias("hi")))).otherwise(acc["bounds"]).alias("bounds"),
            F.when(full, acc["i"] - F.size(kept) + 1).otherwise(acc["lo"]).alias("lo"),
            (acc["i"] + 1).alias("i"),
            (F.when(full, kept_n).otherwise(acc["n"]) + size + 1).alias("n"),
            F.slice(longer, F.greatest(F.size(longer) - overlap, F.lit(1)), overlap + 1).alias("tail"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["i"] >= acc["lo"], F.array_append(acc["bounds"], F.struct(acc["lo"].alias("lo"), acc["i"].alias("hi")))).otherwise(acc["bounds"])

    def packed(v: Column) -> Column:
        return F.transform(F.aggregate(v, zero, step, finish), lambda b: F.array_join(F.slice(v, b["lo"], b["hi"] - b["lo"] + 1), " "))

    return with_value(parts, packed)


_ROW = r"(?m)^(\|.*\|)[ \t]*\n"


def chunks(text: Column, limit: int = dims.MAX_CHUNK, overlap: int = 1) -> Column:
    """Sentence-aware chunks; a text within the limit is one chunk, unchanged. Table rows are kept apart, and a
    sentence that ends with a colon stays with the next."""
    marked = F.regexp_replace(text, _ROW, "$1\u0002\n")
    parts = F.split(marked, r"(?<=[.!?])\s+|(?<=\u0002)\n|(?<=:)[ \t]*\n\s*")
    clean = F.filter(F.transform(parts, lambda x: F.trim(F.replace(x, F.lit("\u0002"), F.lit("")))), lambda x: x != "")
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pack_sentences(merge_after_colon(clean), limit, overlap))


def is_dose_sentence(text: Column, parity: bool = False) -> Column:
    """Long enough, with a digit and a word of dosing. ``parity``: word stems match only as whole words."""
    stems = "|".join(dims.DOSE_CONTEXT)
    pattern = rf"(?i)\b(?:{stems})\b" if parity else rf"(?i)\b(?:{stems})\w*"
    return (F.length(text) >= dims.MIN_FACT) & text.rlike("[0-9]") & (text.rlike(pattern) | text.rlike(r"(?i)\bmg\s+(?:once|twice|oral|daily|bid|tid|qd|per\s+day)\b"))


def years(text: Column, parity: bool = False) -> Column:
    """The years from 2000 to 2099 in a text. ``parity``: numbers with a unit behind them count too."""
    tail = r"\b" if parity else r"\b(?!\s*(?:mg|mcg|g|ml|meq|iu|units?|kg)\b)"
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b(20[0-9]{{2}}){tail}"), F.lit(1)), lambda y: y.cast("int"))
