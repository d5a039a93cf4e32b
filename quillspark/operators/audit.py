"""Citation audit: answers against the nodes they may cite, as set algebra over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import dims
from quillspark.functions import text as T

_CITED = r"\[SOURCE:\s*(urn:[^\]\s]+)\s*\]"
_DOSE = r"(?i)(?<![\p{L}\p{N}.,])\d+(?:[.,]\d+)?\s*(?:mg|mcg|g|ml|units?|iu|meq)(?:/[a-z0-9]+)?(?![\p{L}\p{N}])"


def cited(answers: DataFrame, id_col: str = "answer_id", text_col: str = "text") -> DataFrame:
    """``answer_id, urn_id``: every marker once."""
    return answers.select(F.col(id_col).alias("answer_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(_CITED), F.lit(1)))).alias("urn_id"))


def orphans(answers: DataFrame, id_col: str = "answer_id", text_col: str = "text", window: int = 200) -> DataFrame:
    """``answer_id, orphaned``: dose mentions with no marker within ``window`` characters on either side."""
    text = F.col(text_col)
    marked = F.regexp_replace(text, _CITED, "\u0001$1\u0002")
    far = rf"(?<!\u0001[^\u0002]{{0,{window}}})(?<!\u0002[\s\S]{{0,{window}}}){_DOSE}(?![\s\S]{{0,{window}}}\u0001)"
    return answers.select(F.col(id_col).alias("answer_id"), F.regexp_extract_all(marked, F.lit(far), F.lit(0)).alias("orphaned"))


def audit(answers: DataFrame, nodes: DataFrame, id_col: str = "answer_id", text_col: str = "text") -> DataFrame:
    """``answer_id, hallucinated, verified, missing, misattributed, orphaned, passed`` of every answer.

    ``nodes``: the ``answer_id, urn_id, verbatim_text, verbatim_locked`` that each answer was given. A
    verified citation of a locked node whose 4-grams hardly occur around the marker is misattributed. Missing and
    misattributed citations do not fail an audit. An answer without markers and doses passes.
    """
    base = answers.select(F.col(id_col).alias("answer_id"), F.col(text_col).alias("answer"))
    c = cited(answers, id_col, text_col).withColumn("is_cited", F.lit(True))
    k = nodes.select("answer_id", "urn_id", "verbatim_text", "verbatim_locked").withColumn("known", F.lit(True))
    both = c.join(k, ["answer_id", "urn_id"], "full").join(base, "answer_id", "left")
    both = both.withColumns({"near": T.tokens_by_space(F.lower(T.context_window(F.col("answer"), F.col("urn_id")))), "node": T.tokens_by_space(F.lower(F.coalesce("verbatim_text", F.lit(""))))})
    both = both.withColumns({"near": T.ngrams(F.col("near"), 4), "node": F.array_distinct(T.ngrams(F.col("node"), 4))})
    overlap = F.size(F.array_intersect("node", "near")) / F.greatest(F.size("node"), F.lit(1))
    both = both.withColumn("wrong", F.col("is_cited") & F.col("known") & F.coalesce("verbatim_locked", F.lit(False)) & (overlap < dims.MISQUOTE_OVERLAP))
    pick = lambda cond, name: F.array_sort(F.collect_set(F.when(F.expr(cond), F.col("urn_id")))).alias(name)
    sets = both.groupBy("answer_id").agg(
        pick("is_cited and known is null", "hallucinated"), pick("is_cited and known", "verified"), pick("is_cited is null", "missing"), pick("wrong", "misattributed"),
    )
    out = base.select("answer_id").join(sets, "answer_id", "left").join(orphans(answers, id_col, text_col), "answer_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({n: F.coalesce(F.col(n), none) for n in ("hallucinated", "verified", "missing", "misattributed", "orphaned")})
    return out.withColumn("passed", (F.size("hallucinated") == 0) & (F.size("orphaned") == 0))
