"""Filtered vector search, hybrid scoring, late-interaction re-ranking and first-wins unions.

Every ranking ends with the key, so ties have one order. Vectors are never carried past scoring.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import dims
from quillspark.functions import vectors as V


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def knn(df: DataFrame, query: list[float], k: int, id_col: str, vector_col: str, where: Column | None = None) -> DataFrame:
    """``id, score``: the ``k`` rows of the greatest dot product with a constant query vector, filtered first."""
    rows = df.where(where) if where is not None else df
    return best_scores(rows.select(F.col(id_col).alias("id"), V.dot(F.col(vector_col), literal_vector(query)).alias("score")), k)


def best_scores(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` greatest of ``id, score``; rows without a score drop out."""
    return scored.where("score is not null and not isnan(score)").orderBy(F.desc("score"), "id").limit(k)


def knn_batch(df: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, block: int = 1000) -> DataFrame:
    """``query_id, id, score, rank`` for a table ``query_id, query_vector``, sent to all executors in blocks of about ``block`` rows."""
    blocks = max(1, -(-queries.count() // block))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))

    def best(asked: DataFrame) -> DataFrame:
        scored = rows.join(F.broadcast(asked)).select("query_id", "id", V.dot(F.col("v"), F.col("query_vector")).alias("score"))
        return scored.where("score is not null and not isnan(score)").withColumn("rank", rank).where(F.col("rank") <= k)

    return reduce(DataFrame.unionByName, [best(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)) for i in range(blocks)])


def recency(score: Column, date: Column, cutoff: Column, boost: float = dims.RECENCY_BOOST, neutral: float = 0.0) -> Column:
    """Adds the boost on or after the cutoff, ``neutral`` otherwise and for null dates."""
    return score + F.when(date >= cutoff, F.lit(boost)).otherwise(F.lit(neutral))


def cutoff_of(today: Column, years: int = dims.RECENT_YEARS) -> Column:
    """The first of January of this year, less ``years`` times 365 days."""
    return F.date_sub(F.trunc(today, "YEAR"), years * 365)


def hybrid(text_scores: DataFrame, vector_scores: DataFrame, k: int, vector_boost: float = dims.VECTOR_BOOST, by: str | None = None) -> DataFrame:
    """``id, score, rank``: scores of both branches added, either may be missing; vector scores count as ``(1 + dot) / 2``.

    ``by`` names a column of both sides (a question) within which the ``k`` best are taken.
    """
    keys = [by] if by else []
    a, b = text_scores.select(*keys, "id", F.col("score").alias("ts")), vector_scores.select(*keys, "id", ((1 + F.col("score")) / 2 * vector_boost).alias("vs"))
    both = a.join(b, [*keys, "id"], "full").select(*keys, "id", (F.coalesce("ts", F.lit(0.0)) + F.coalesce("vs", F.lit(0.0))).alias("score"))
    if not by:
        both = both.orderBy(F.desc("score"), "id").limit(k)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def rerank(hits: DataFrame, query_vectors: list[list[float]] | Column, vectors_col: str, k: int, pool_cols: list[str]) -> DataFrame:
    """The ``k`` best hits of each pool by late interaction; ties keep the retrieval ``rank``.

    ``query_vectors``: those of one question, or a column that holds each hit's question's. Without query vectors
    the order stays. Hits without vectors score 0.
    """
    asked = isinstance(query_vectors, Column) or bool(query_vectors)
    query = query_vectors if isinstance(query_vectors, Column) else F.array(*[literal_vector(q) for q in query_vectors])
    score = V.maxsim(query, F.coalesce(F.col(vectors_col), F.array().cast("array<array<float>>"))) if asked else F.lit(0.0)
    scored = hits.withColumn("maxsim", score).drop(vectors_col)
    order = [F.desc("maxsim"), "rank"] if asked else ["rank"]
    return scored.withColumn("pool_rank", F.row_number().over(Window.partitionBy(*pool_cols).orderBy(*order))).where(F.col("pool_rank") <= k)


def union_first(pools: list[DataFrame] | DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, from the first pool (by ``order``) that has it."""
    rows = pools if isinstance(pools, DataFrame) else reduce(DataFrame.unionByName, pools)
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_first = 1").drop("_first")
