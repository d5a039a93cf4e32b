"""Inverted index and BM25 as ordinary tables.

``Index`` writes the postings once, partitioned by a hash of the term, with the statistics of each field; a
search then reads the partitions of its own terms and nothing else. ``bm25`` scores a table that has no
index in one pass: query terms are plan-time constants, and only rows that hold one are kept. ``Scan`` does
so for several fields, with the searches of an ``Index``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import dims
from quillspark.functions import text as T
from quillspark.runtime import scratch_file, stage


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, tf``."""
    return df.select(F.col(id_col).alias("id"), F.explode(T.tokens(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def lengths(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, dl``: number of tokens."""
    return df.select(F.col(id_col).alias("id"), F.size(T.tokens(F.col(text_col))).cast("long").alias("dl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def bm25(df: DataFrame, terms: list[str], id_col: str, text_col: str, k1: float = dims.BM25_K1, b: float = dims.BM25_B) -> DataFrame:
    """``id, score`` of every row that holds a query term.

    One pass over the text gives, per row, its length and the counts of the (few) query terms; the
    corpus statistics are one aggregated row of that pass. Repeated query terms count once.
    """
    terms = list(dict.fromkeys(terms))
    words = T.tokens(F.col(text_col))
    counts = [F.size(F.filter("words", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = df.select(F.col(id_col).alias("id"), words.alias("words")).select("id", F.size("words").cast("long").alias("dl"), *counts)
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"tf{i}")
        score = score + idf(F.col("n"), F.col(f"df{i}")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    any_hit = F.lit(False)
    for i in range(len(terms)):
        any_hit = any_hit | (F.col(f"tf{i}") > 0)
    return rows.where(any_hit).join(F.broadcast(stats)).select("id", score.alias("score"))


_PHRASES = sorted(((p, g[0]) for g in dims.SYNONYMS for p in g[1:]), key=lambda x: (-len(x[0]), x[0]))


def expand_synonyms(text: Column) -> Column:
    """Lower-case text in which every phrase of a synonym group is its group's first, longest phrases first."""
    low = out = F.lower(text)
    for phrase, head in _PHRASES:
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}]){T.quoted(phrase)}(?![\p{{L}}\p{{N}}])", head)
    # One look decides whether a text holds any phrase at all.
    return F.when(low.rlike("|".join(T.quoted(p) for p, _ in _PHRASES)), out).otherwise(low)


def expanded(text: str) -> str:
    """``expand_synonyms`` of a plan-time text."""
    out = text.lower()
    for phrase, head in _PHRASES:
        out = re.sub(rf"(?<![^\W_]){re.escape(phrase)}(?![^\W_])", head, out)
    return out


def query_terms(text: str, synonyms: bool = False) -> list[str]:
    """The distinct tokens of a plan-time text, as ``functions.text.tokens`` cuts them."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", expanded(text) if synonyms else text.lower())))


@dataclass(frozen=True)
class Index:
    """Postings (``field, term, id, tf, dl, bucket``) and statistics (``field, n, avgdl``) in the folder ``path``.

    With ``synonyms``, texts are indexed, and questions asked, with every phrase of a synonym group as its first.
    """

    spark: SparkSession
    path: str
    synonyms: bool = False
    buckets: int = 64

    @classmethod
    def build(cls, df: DataFrame, id_col: str, fields: list[str], path: str | None = None, synonyms: bool = False, buckets: int | None = None) -> Index:
        """One pass over the texts; every row counts in ``n``, those without text with no tokens. ``path`` defaults to scratch
        space, ``buckets`` to the session's shuffle partitions (at most 1,024)."""
        spark = df.sparkSession
        buckets = buckets or min(1024, int(spark.conf.get("spark.sql.shuffle.partitions")))
        index = cls(spark, path or scratch_file(spark, "postings"), synonyms, buckets)
        words = [T.tokens(expand_synonyms(F.col(f)) if synonyms else F.col(f)) for f in fields]
        each = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), w.alias("words")) for f, w in zip(fields, words)])).alias("x")).select("id", "x.*").withColumn("dl", F.size("words").cast("long"))
        each.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/statistics")
        postings = each.select("id", "field", "dl", F.explode("words").alias("term")).groupBy("field", "term", "id", "dl").agg(F.count("*").alias("tf"))
        # Within its partition a term's postings lie together, so a reader skips all others.
        bucketed = postings.withColumn("bucket", index._bucket(F.col("term"))).repartition("bucket", F.pmod(F.hash("id"), F.lit(4))).sortWithinPartitions("bucket", "term")
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings")
        return index

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.hash(term), F.lit(self.buckets)).cast("int")

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of the terms; the partitions of other terms are not read."""
        at = sorted({r.b for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term")).alias("b")).collect()})
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(at) & F.col("term").isin(terms))

    def search(self, question: str, weights: dict[str, float], boost: float = 1.0, k1: float = dims.BM25_K1, b: float = dims.BM25_B) -> DataFrame:
        """``id, score``: the best weighted field's BM25 of every row that holds a term of the question, times the boost."""
        terms = query_terms(question, self.synonyms)
        hits = self.postings(terms or [""]).where(F.col("field").isin(list(weights)))
        df = F.broadcast(hits.groupBy("field", "term").agg(F.count("*").alias("df")))
        stats = F.broadcast(self.spark.read.parquet(f"{self.path}/statistics"))
        part = idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        scored = hits.join(df, ["field", "term"]).join(stats, "field").select("id", "field", part.alias("part"))
        weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(w))) for f, w in weights.items()])
        fields = scored.groupBy("id", "field").agg(F.sum("part").alias("s")).select("id", (F.col("s") * weight).alias("s"))
        return fields.groupBy("id").agg((F.max("s") * boost).alias("score"))


def _among(terms: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(terms)


@dataclass(frozen=True)
class Scan:
    """The searches of an ``Index`` over a table of few questions: only the counts of a question's terms are written.

    ``df`` has one row per id. Later searches for the same terms use the same counts.
    """

    df: DataFrame
    id_col: str
    fields: list[str]
    synonyms: bool = False
    _counts: dict[tuple[str, ...], DataFrame] = field(default_factory=dict)

    def counts(self, terms: list[str]) -> DataFrame:
        """``id`` and, for each field, the number ``dl`` of its tokens and ``tf`` of each term; one pass over the texts."""
        if tuple(terms) not in self._counts:
            at = range(len(self.fields))
            words = [T.tokens(expand_synonyms(F.col(f)) if self.synonyms else F.col(f)).alias(f"words{i}") for i, f in enumerate(self.fields)]
            hits = self.df.select(F.col(self.id_col).alias("id"), *words).select("id", *[F.size(f"words{i}").cast("long").alias(f"dl{i}") for i in at], *[F.filter(f"words{i}", _among(terms)).alias(f"hits{i}") for i in at])
            tf = [F.array(*[F.size(F.filter(f"hits{i}", _equals(t))) for t in terms]).alias(f"tf{i}") for i in at]
            self._counts[tuple(terms)] = stage(hits.select("id", *[f"dl{i}" for i in at], *tf), "counts")
        return self._counts[tuple(terms)]

    def search(self, question: str, weights: dict[str, float], boost: float = 1.0, k1: float = dims.BM25_K1, b: float = dims.BM25_B) -> DataFrame:
        """``id, score``, as ``Index.search`` gives them."""
        terms = query_terms(question, self.synonyms) or [""]
        rows = self.counts(terms)
        used = [(i, float(weights[f])) for i, f in enumerate(self.fields) if f in weights]
        tf = lambda i, j: F.get(f"tf{i}", F.lit(j))
        averages = [F.avg(f"dl{i}").alias(f"avgdl{i}") for i, _ in used]
        stats = rows.agg(F.count("*").alias("n"), *averages, *[F.count_if(tf(i, j) > 0).alias(f"df{i}_{j}") for i, _ in used for j in range(len(terms))])
        parts = []
        for i, weight in used:
            total = F.lit(0.0)
            for j in range(len(terms)):
                part = idf(F.col("n"), F.col(f"df{i}_{j}")) * tf(i, j) * (k1 + 1) / (tf(i, j) + k1 * (1 - b + b * F.col(f"dl{i}") / F.col(f"avgdl{i}")))
                total = total + F.when(tf(i, j) > 0, part).otherwise(F.lit(0.0))
            parts.append(F.when(F.array_max(f"tf{i}") > 0, total * weight))
        scored = rows.join(F.broadcast(stats)).select("id", (F.array_max(F.array(*parts)) * boost).alias("score"))
        return scored.where("score is not null")
