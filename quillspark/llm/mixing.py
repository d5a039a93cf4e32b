"""Problem 7: mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks.

Records are sized with a public tokenizer. Within each source, hash shards pack their records, in
seeded order, into blocks of equal size. Seats, each one block, go to the sources by highest
quotients ``target / (2 n + 1)``, no source beyond ``max_repeats`` times its blocks; each source's seats are
apportioned to its shards the same way, which gives integer quotas per shard, and every shard then
takes its blocks in seeded order: all of them as often as the quota covers all, and the first of the
order once more.

Only the totals per source and shard reach the driver: there are at most ``max_shards`` shards and as many
sources as ``targets`` has rows.

Defined results: the total defaults to the largest at which no source that has records falls short.
A source without records gets nothing, and the others keep their proportions among themselves; the
report shows the share that was reached. Source names that differ in case, outer space or ``-`` for ``_`` are
the same. Records without text or id or with a null source, or whose source has no target, are not used.
Records fetched twice under two ids are two records. An empty table gives no rows and reached shares of 0.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from heapq import heapify, heapreplace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import stage
from quillspark.llm.truncation import source_name

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts a text before merging; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str) -> DataFrame:
    """``doc_id, source, tokens`` of the records with text and a source."""
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), source_name(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))

    with open(vocabulary, "rb") as f:  # on the driver only; the workers get it by broadcast
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encode = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": [len(encode(t)) for t in batch["text"]]})

    return base.where("doc_id is not null and text is not null and source is not null").mapInPandas(run, "doc_id long, source string, tokens long").where("tokens > 0")


def sainte_lague(weights: list[float], capacity: list[int], seats: int) -> list[int]:
    """Seats by highest quotients ``w / (2 n + 1)``, ties to the first, none beyond its capacity.

    A divisor just above the final one gives most seats at once; the rest go one by one.
    """
    seats = min(seats, sum(c for w, c in zip(weights, capacity) if w > 0))
    given = lambda d: [min(c, int(w / d + 0.5)) if w > 0 else 0 for w, c in zip(weights, capacity)]
    real = [w for w in weights if w > 0]
    if not real or not seats:
        return [0] * len(weights)
    low, high = min(real) / (2 * max(capacity) + 2), max(real) * 2.1
    while high / low > 1 + 1e-12:
        mid = (low * high) ** 0.5
        if sum(given(mid)) > seats:
            low = mid
        else:
            high = mid
    got = given(high)
    queue = [(-w / (2 * n + 1), i) for i, (w, n, c) in enumerate(zip(weights, got, capacity)) if w > 0 and n < c]
    heapify(queue)
    for _ in range(seats - sum(got)):
        while got[queue[0][1]] >= capacity[queue[0][1]]:
            heapreplace(queue, (float("inf"), queue[0][1]))
        i = queue[0][1]
        got[i] += 1
        heapreplace(queue, (-weights[i] / (2 * got[i] + 1) if got[i] < capacity[i] else float("inf"), i))
    return got


def mixed(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    vocabulary: str = VOCABULARY, block_tokens: int | None = None, shard_tokens: int = 20_000_000, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """The mixture (``doc_id, source, tokens, times``) and its report (``source, target_share, reached_share, ...``).

    ``block_tokens`` defaults to a thousandth of the smallest target, at least 1,024 tokens; a block ends with
    the record that fills it.
    """
    wanted = [(r.s, float(r.w or 0), int(r.m or 0)) for r in targets.groupBy(source_name(F.col("source")).alias("s")).agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("m")).where("s is not null").orderBy("s").toLocalIterator()]
    spark = docs.sparkSession
    weights = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in wanted], "source string"))
    sized = stage(token_counts(docs, id_col, text_col, source_col, vocabulary).join(weights, "source", "left_semi").select("doc_id", "source", "tokens"), "p7-sizes")
    have = {r.source: (r.tokens, r.docs) for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    usable = {s: have.get(s, (0, 0))[0] * m for s, _, m in wanted}
    real = [s for s, w, _ in wanted if w > 0 and usable[s]]
    share = {s: w for s, w, _ in wanted}
    if total_tokens is None:
        total_tokens = int(min((usable[s] / share[s] for s in real), default=0) * sum(share[s] for s in real))
    if block_tokens is None:
        block_tokens = max(1024, int(total_tokens * min((share[s] for s in real), default=0) / 1000))
    shards = max(1, round(max((t for t, _ in have.values()), default=0) / shard_tokens))
    clusters = math.ceil(shards**0.5)

    in_shard = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    packed = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(shards)).cast("int"))
    packed = packed.withColumn("block", F.floor((F.sum("tokens").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")) / F.lit(block_tokens)))
    packed = stage(packed, "p7-packed")
    blocks = packed.groupBy("source", "shard", "block").agg(F.sum("tokens").alias("n"))
    per_shard = stage(blocks.groupBy("source", "shard").agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).withColumn("cluster", F.col("shard") % clusters), "p7-shards")
    per_cluster: dict[str, list[tuple[int, int, int]]] = {s: [] for s, _, _ in wanted}
    for r in per_shard.groupBy("source", "cluster").agg(F.sum("blocks").alias("blocks"), F.sum("n").alias("n")).orderBy("source", "cluster").toLocalIterator():
        per_cluster[r.source].append((r.cluster, r.blocks, r.n))

    # Blocks hold block_tokens on average only; a source's seats are weighed by what its blocks really hold.
    names = [s for s, _, _ in wanted]
    mean = {s: sum(x[2] for x in per_cluster[s]) / max(1, sum(x[1] for x in per_cluster[s])) for s in names}
    seats = sum(round(total_tokens * share[s] / sum(share[x] for x in real) / mean[s]) for s in real)
    quota = dict(zip(names, sainte_lague([share[s] / mean[s] if mean[s] else 0.0 for s in names], [m * sum(x[1] for x in per_cluster[s]) for s, _, m in wanted], seats)))
    rows = []
    for s, _, m in wanted:
        parts = per_cluster[s]
        rows += [(s, cluster, q, m) for (cluster, _, _), q in zip(parts, sainte_lague([float(x[2]) for x in parts], [m * x[1] for x in parts], quota[s]))]

    def to_shards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        got = sainte_lague(group["n"].astype(float).tolist(), (group["m"] * group["blocks"]).tolist(), int(group["seats"].iloc[0]))
        return pd.DataFrame({"source": group["source"], "shard": group["shard"], "rounds": [q // n for q, n in zip(got, group["blocks"])], "more": [q % n for q, n in zip(got, group["blocks"])]})

    seated = per_shard.join(F.broadcast(spark.createDataFrame(rows, "source string, cluster int, seats long, m long")), ["source", "cluster"])
    plan = seated.groupBy("source", "cluster").applyInPandas(to_shards, "source string, shard int, rounds long, more long")
    drawn = F.row_number().over(Window.partitionBy("source", "shard").orderBy(F.xxhash64("block", F.lit(seed + 2)), "block"))
    chosen = blocks.join(plan, ["source", "shard"]).withColumn("times", F.col("rounds") + (drawn <= F.col("more")).cast("int")).where("times > 0")
    mixture = packed.join(chosen.select("source", "shard", "block", "times"), ["source", "shard", "block"]).select("doc_id", "source", "tokens", "times")

    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"), F.sum("times").alias("used_records"), F.max("times").alias("most_repeats"))
    base = spark.createDataFrame([(s, w, m, have.get(s, (0, 0))[0], have.get(s, (0, 0))[1]) for s, w, m in wanted], "source string, target_share double, max_repeats int, available_tokens long, available_records long")
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    report = base.join(F.broadcast(used), "source", "left").na.fill(0, ["used_tokens", "used_records", "most_repeats"])
    report = report.withColumn("reached_share", F.coalesce(F.round(F.try_divide(F.col("used_tokens"), all_used), 6), F.lit(0.0)))
    return mixture, report.withColumn("at_limit", F.col("used_tokens") >= F.col("available_tokens") * F.col("max_repeats"))
