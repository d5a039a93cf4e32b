"""Dictionary names and n-grams in texts, by joins on tokens instead of scans per name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def names_in_texts(texts: DataFrame, dictionary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, name``: the names of ``dictionary`` (``name``), of any number of words, that occur in each text, once each.

    A name is found by its words, whatever stands between them. One join on runs of as many words as names have;
    only the distinct numbers of words reach the driver.
    """
    names = dictionary.select("name", T.tokens(F.col("name")).alias("_w")).select("name", F.array_join("_w", " ").alias("_key"), F.size("_w").alias("_n")).where("_n > 0").distinct()
    sizes = sorted(r["_n"] for r in names.select("_n").distinct().collect())
    words = texts.select(F.col(id_col), T.tokens(F.col(text_col)).alias("_w"))
    runs = F.array_distinct(F.flatten(F.array(*[T.ngrams(F.col("_w"), n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    return words.select(id_col, F.explode(runs).alias("_key")).join(names, "_key").select(id_col, "name").distinct()


def containment(items: DataFrame, docs: DataFrame, item_id: str, doc_id: str, text_col: str, n: int, least: float) -> DataFrame:
    """``doc, item, shared, containment`` for pairs that share at least ``least`` of the item's distinct n-grams.

    The grams of the items filter those of the documents before anything is shuffled by document.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        # Tokens are a column of their own: inside the n-gram lambda they would be cut anew for every n-gram.
        words = df.select(F.col(key), T.tokens(F.col(text_col)).alias("w"))
        return words.select(key, F.explode(F.array_distinct(T.ngrams(F.col("w"), n))).alias("gram"))

    wanted = grams(items, item_id)
    total = wanted.groupBy(item_id).agg(F.count("*").alias("total"))
    shared = grams(docs, doc_id).join(wanted, "gram").groupBy(doc_id, item_id).agg(F.count("*").alias("shared"))
    return shared.join(total, item_id).where(F.col("shared") / F.col("total") >= least).select(doc_id, item_id, "shared", F.round(F.col("shared") / F.col("total"), 6).alias("containment"))
