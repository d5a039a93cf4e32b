"""Problem 5: records that are identical except for formatting.

Every text is reduced to its words (and, for lists of fields, to the sorted multiset of its
``name: value`` segments), hashed to 128 bits on the JVM and grouped by that hash with map-side
partial aggregation. A further 32-bit hash of the canonical text is part of the grouping key, so that
two texts which collide in the 128 bits still form two groups; ``collisions`` counts such cases.

One word sequence may stand for several lists of fields (where the separators differ) and one list
for several sequences, so sequences and lists that share a text are joined by components; only lists
met under a sequence with another list take part in that.

Defined results: a null, empty or word-less text belongs to no group. Equal rows are copies of each
other; the smallest ``row_id`` is kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.runtime import attach_groups, first_value, stage

#: Everything that is no word: a point or comma counts as part of a number only between two digits. Only
#: single characters and character classes repeat, so that runs of any length need no recursion.
BETWEEN_WORDS = r"[^\p{L}\p{N}.,]+|(?<!\p{Nd})[.,]|[.,](?!\p{Nd})"
#: A segment that is a name of one to three words, a colon and a value.
FIELD = r"(?s)^[^\p{L}\p{N}:]*[\p{L}\p{N}]+(?:[^\p{L}\p{N}:]+[\p{L}\p{N}]+){0,2}[^\p{L}\p{N}:]*:.*[\p{L}\p{N}]"
SEGMENTS = r"[;|\r\n]+"


def words_of(text: Column) -> Column:
    """The words of a text in order, joined by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), BETWEEN_WORDS, " "), " {2,}", " "))


def field_of(segment: Column) -> Column:
    """The words of a field's name and those of its value, kept apart."""
    name = F.substring_index(segment, ":", 1)
    return F.concat(words_of(name), F.lit("\u0002"), words_of(F.substring(segment, F.length(name) + 2, F.length(segment))))


def fields_of(text: Column) -> Column:
    """The sorted fields of a text that is a list of at least three fields, joined; otherwise null."""
    segments = F.filter(F.split(text, SEGMENTS), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    is_list = (F.size(segments) >= 3) & F.forall(segments, lambda s: s.rlike(FIELD))
    canonical = F.array_join(F.array_sort(F.transform(segments, field_of)), "\u0001")
    # Cheap counts first: a list of fields has at least three colons and two separators.
    colons = F.length(text) - F.length(F.translate(text, ":", ""))
    cuts = F.length(text) - F.length(F.translate(text, ";|\r\n", ""))
    return F.when((colons >= 3) & (cuts >= 2), F.when(is_list, canonical))


def hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h1, h2, check`` of the word sequence and ``f1, f2`` of the fields (null without fields)."""
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    canon = base.select("id", words_of(F.col("text")).alias("w"), fields_of(F.col("text")).alias("f"))
    return canon.where(F.col("w") != "").select(
        "id",
        F.xxhash64("w").alias("h1"),
        F.xxhash64(F.lit(7), "w").alias("h2"),
        F.hash("w").alias("check"),
        F.when(F.col("f").isNotNull(), F.xxhash64("f")).alias("f1"),
        F.when(F.col("f").isNotNull(), F.xxhash64(F.lit(7), "f")).alias("f2"),
        F.when(F.col("f").isNotNull(), F.hash("f")).alias("f3"),
    )


def collapse(df: DataFrame, id_col: str = "row_id", text_col: str = "verbatim_text") -> tuple[DataFrame, DataFrame, int]:
    """Group formatting copies.

    Returns the hashed rows, the groups (``h1, h2, check`` of each word sequence with ``keep`` = the
    smallest id of its group and ``copies`` = the group's size), and the number of hashed rows.

    Texts with the same word sequence are one group, and so are lists with the same fields.
    """
    rows = stage(hashed(df, id_col, text_col), "p5-hashed")
    key, field = ["h1", "h2", "check"], F.concat_ws("-", "f1", "f2", "f3")
    own = stage(rows.groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max(F.col("f1").isNotNull().cast("int")).alias("is_list")), "p5-sequences")
    lists = stage(rows.where("f1 is not null").select(*key, field.alias("f")).distinct(), "p5-lists")
    #: Of a sequence with several lists, all are linked with the least.
    least = lists.groupBy(*key).agg(F.min("f").alias("g"))
    roots = components(lists.join(least, key).select(F.col("f").alias("a"), F.col("g").alias("b")).where("a <> b"))
    rooted = own.where("is_list = 1").join(least, key).join(roots.withColumnRenamed("node", "g"), "g", "left").withColumn("root", F.coalesce("root", "g"))
    merged = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("copies"))
    #: Only lists can share a group across word sequences, so the rest needs no second shuffle.
    groups = (
        own.where("is_list = 0").select(*key, F.col("first").alias("keep"), F.col("n").alias("copies"), "n")
        .unionByName(rooted.join(merged, "root").select(*key, "keep", "copies", "n"))
    )
    return rows, groups, first_value(own, F.coalesce(F.sum("n"), F.lit(0)))


def copies(df: DataFrame, id_col: str = "row_id", text_col: str = "verbatim_text") -> DataFrame:
    """``keep_row_id, copy_row_id``: one row for every copy but the kept one."""
    rows, groups, total = collapse(df, id_col, text_col)
    found = attach_groups(rows.select("id", "h1", "h2", "check"), groups.where("copies > 1"), ["h1", "h2", "check"], "n", total)
    return found.where("id <> keep").select(F.col("keep").alias("keep_row_id"), F.col("id").alias("copy_row_id"))


def records(df: DataFrame, id_col: str = "row_id", text_col: str = "verbatim_text") -> DataFrame:
    """``keep_row_id, copies``: one row for every distinct record, with how many copies it had (itself included)."""
    _, groups, _ = collapse(df, id_col, text_col)
    return groups.groupBy("keep").agg(F.max("copies").alias("copies")).select(F.col("keep").alias("keep_row_id"), "copies")


def collisions(df: DataFrame, id_col: str = "row_id", text_col: str = "verbatim_text") -> DataFrame:
    """``n_collisions``: 128-bit hashes of word sequences that stand for more than one (told apart by the check hash)."""
    rows = hashed(df, id_col, text_col)
    return (
        rows.groupBy("h1", "h2").agg(F.min("check").alias("a"), F.max("check").alias("b"))
        .agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_collisions"))
    )
