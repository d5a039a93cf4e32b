"""Problem 1: near-duplicate records, by sequential Bayesian verification of banded candidates.

1. Python workers turn each text into its set of hashed word runs, a 128-bit id of that set,
   MinHash bands, and a signature of one byte per further, independent hash function.
2. Texts with equal sets form one class, named by its smallest row id from there on. Classes are what
   meets in buckets, so a hot group of copies is one member.
3. In every bucket each member is paired with one centre, drawn afresh per bucket. Hot buckets are found
   by a sketch and salted, so none is ever held by one task.
4. After the links so found are joined into components, all members of a bucket that still lie in
   different components are compared, once: buckets of up to ``small`` members by a join of the bucket
   with itself; larger ones in blocks of ``block`` members, each pair of blocks one task that prunes and
   verifies its pairs and gives one link for each member and other component, so that no pairs leave it.
   Only buckets of more than ``huge`` members are first split by ``TRIPLES`` triples of signature
   bytes, where two members at the threshold meet again with a probability above 0.9999.
5. A pair's signatures are compared batch by batch. It is dropped as soon as the posterior
   probability that its similarity reaches the threshold falls below ``miss``; survivors are
   verified exactly on their texts. Two rounds do it, whatever the sizes of buckets.
6. Links are joined into components without leaving the executors.

Defined results: texts that are null or shorter than ``width`` words, and rows without an id, take no part. Repeated rows and
equal texts are in one group. Set ids compare without regard to case; a null set id is no set id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.runtime import attach_groups, first_value, hot_values, release, stage

WORD = re.compile(r"[^\W_]+")
BANDS, ROWS, SIGNATURE, BATCH = 48, 4, 64, 16
#: Triples of signature bytes that split large buckets: the bytes in order, and again in steps of 5.
_ORDERS = (list(range(SIGNATURE)), [i * 5 % SIGNATURE for i in range(SIGNATURE)])
TRIPLES = [o[i : i + 3] for o in _ORDERS for i in range(0, SIGNATURE - 2, 3)]
#: A list of ids of up to this length is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket that one task holds on either side, and the parts of a hot bucket.
BLOCK, HUGE, SALTS = 2048, 65_536, 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to the sorted, distinct 64-bit hashes of their runs of ``width`` words."""

    def __init__(self, width: int, cache: int = 1 << 19) -> None:
        self.width, self.cache, self.known = width, cache, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All hashes, and where each text's hashes start (one more entry than texts)."""
        from xxhash import xxh3_64_intdigest

        known, w = self.known, self.width
        if len(known) > self.cache:
            known.clear()
        flat: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = WORD.findall(text.lower()) if text else ()
            sizes[i] = len(words)
            for x in words:
                h = known.get(x)
                if h is None:
                    h = known[x] = xxh3_64_intdigest(x)
                flat.append(h)
        h = np.array(flat, np.uint64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        n = len(h) - w + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        with np.errstate(over="ignore"):
            runs = np.zeros(n, np.uint64)
            for k in range(w):
                runs = _mix(runs * _MIX + h[k : k + n] + np.uint64(k + 1))
        inside = np.arange(n) + w <= ends[owner[:n]]
        runs, owner = runs[inside], owner[:n][inside]
        order = np.lexsort((runs, owner))
        runs, owner = runs[order], owner[order]
        fresh = np.ones(len(runs), bool)
        fresh[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
        runs, owner = runs[fresh], owner[fresh]
        return runs, np.searchsorted(owner, np.arange(len(texts) + 1))


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, np.uint32)


def minhashes(runs: np.ndarray, starts: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of every text (rows) under every function (columns)."""
    out, short, h = np.empty((len(starts) - 1, len(factors)), np.uint32), (runs >> np.uint64(24)).astype(np.uint32), np.empty(len(runs), np.uint32)
    for k in range(len(factors)):
        np.multiply(short, factors[k], out=h)
        np.add(h, shifts[k], out=h)
        out[:, k] = np.minimum.reduceat(h, starts[:-1])
    return out


def signatures(df: DataFrame, width: int, seed: int) -> DataFrame:
    """``id, set_hash (0 for none), k, k2, bands, sig`` of every text that takes part; bands and sig once per class and task."""
    factors, shifts = _functions(BANDS * ROWS + SIGNATURE, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, seen = Shingler(width), set()
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                runs, starts = shingle(part["text"].tolist())
                full = np.diff(starts) > 0
                part, starts = part[full], np.append(starts[:-1][full], len(runs))
                if not len(part):
                    continue
                with np.errstate(over="ignore"):
                    k = _mix(np.add.reduceat(_mix(runs + np.uint64(seed)), starts[:-1]) + np.diff(starts).astype(np.uint64))
                    k2 = np.bitwise_xor.reduceat(_mix(runs * _MIX), starts[:-1])
                k, k2 = k.view(np.int64), k2.view(np.int64)
                new = np.zeros(len(part), bool)
                for i, x in enumerate(zip(k.tolist(), k2.tolist())):
                    if x not in seen:
                        new[i] = True
                        seen.add(x)
                if len(seen) > 1 << 20:
                    seen.clear()
                bands, sigs = [None] * len(part), [None] * len(part)
                if new.any():
                    at = np.flatnonzero(new)
                    size = np.diff(starts)[at]
                    keep = np.repeat(new, np.diff(starts))
                    low = minhashes(runs[keep], np.append(0, np.cumsum(size)), factors, shifts)
                    with np.errstate(over="ignore"):
                        band = np.zeros((len(at), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                        for r in range(ROWS):
                            band = _mix(band * _MIX + low[:, r : BANDS * ROWS : ROWS] + np.uint64(1))
                        sig = (low[:, BANDS * ROWS :] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                    for i, j in enumerate(at):
                        bands[j], sigs[j] = band[i].view(np.int64), sig[i].tobytes()
                yield pd.DataFrame({"id": part["id"].to_numpy(), "set_hash": part["set_hash"].to_numpy(), "k": k, "k2": k2, "bands": bands, "sig": sigs})

    return df.mapInPandas(run, "id long, set_hash long, k long, k2 long, bands array<long>, sig binary")


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """``compared, matches``: after so many signature bytes, fewer matches than these mean a posterior
    probability under ``miss`` that the similarity reaches the threshold (uniform prior)."""
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        for m in range(n + 1):
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p))
            if like[s >= threshold].sum() / like.sum() >= miss:
                out.append((n, m))
                break
    return out


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, SIGNATURE)


def _alive(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The rows at which two matrices of signatures stay probable, batch by batch."""
    alive, same, done = np.arange(len(a)), np.zeros(len(a), int), 0
    for n, m in bounds:
        same = same + (a[alive, done:n] == b[alive, done:n]).sum(1)
        keep = same >= m
        alive, same, done = alive[keep], same[keep], n
    return alive


def _pruned(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    bounds = least_matches(threshold, miss)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.iloc[_alive(_matrix(batch["sa"]), _matrix(batch["sb"]), bounds)][["a", "b"]]

    sa, sb = sigs.select(F.col("k").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("k").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(sa, "a").join(sb, "b").mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(width)
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for lo in range(0, len(batch), 2000):
                part = batch.iloc[lo : lo + 2000]
                # A text of several pairs is cut into words once.
                at, texts = pd.factorize(np.concatenate([part["ta"].to_numpy(), part["tb"].to_numpy()]))
                runs, starts = shingle(texts.tolist())
                for i, (a, b) in enumerate(zip(at[: len(part)], at[len(part) :])):
                    x, y = runs[starts[a] : starts[a + 1]], runs[starts[b] : starts[b + 1]]
                    z = np.concatenate((x, y))
                    z.sort()
                    both = int((z[1:] == z[:-1]).sum())
                    keep[lo + i] = both >= threshold * (len(x) + len(y) - both) - 1e-9
            yield batch[keep][["a", "b"]]

    ta, tb = texts.select(F.col("k").alias("a"), F.col("text").alias("ta")), texts.select(F.col("k").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").mapInPandas(run, "a long, b long")


def _met(entries: DataFrame) -> DataFrame:
    """``bucket, k, centre, n`` of the buckets with several members.

    The centre is the member whose id gives the least value when mixed with the bucket, which can be undone.
    Members are shuffled once, those of hot buckets by a salt too; such buckets take the least over their salts.
    """
    hot, key = hot_values(entries, "bucket"), ["bucket"]
    is_hot = F.col("bucket").isin(hot)
    if hot:
        entries, key = entries.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("k"), F.lit(SALTS))).otherwise(0)), ["bucket", "salt"]
    spread = entries.repartition(*key)
    least = spread.groupBy(*key).agg(F.min(F.col("k").bitwiseXOR(F.col("bucket"))).alias("c"), F.count("*").alias("n"))
    if hot:
        whole = least.where(is_hot).groupBy("bucket").agg(F.min("c").alias("c_all"), F.sum("n").alias("n_all"))
        least = least.join(F.broadcast(whole), "bucket", "left").select(*key, F.coalesce("c_all", "c").alias("c"), F.coalesce("n_all", "n").alias("n"))
    met = spread.join(least.where("n > 1"), key)
    return met.select("bucket", "k", F.col("c").bitwiseXOR(F.col("bucket")).alias("centre"), "n")


def _named(entries: DataFrame, comps: DataFrame) -> DataFrame:
    return entries.join(comps.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))


def _mixed(named: DataFrame) -> DataFrame:
    """``bucket, n`` of the buckets that hold several components."""
    held = named.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("n"))
    return held.where("r1 <> r2").select("bucket", "n")


def _finer(large: DataFrame, sigs: DataFrame) -> DataFrame:
    """``bucket, k, root``: a finer bucket for every triple of signature bytes of the members of large buckets."""
    members = large.join(sigs, "k")
    keys = F.array(*[F.xxhash64(F.col("bucket"), F.lit(t), *[F.substring("sig", i + 1, 1) for i in places]) for t, places in enumerate(TRIPLES)])
    return members.select("k", "root", F.explode(keys).alias("bucket"))


def _joined_pairs(named: DataFrame, sizes: DataFrame, small: int) -> DataFrame:
    """Pairs of different components in buckets of at most ``small`` members."""
    x = named.join(sizes.where(F.col("n") <= small).select("bucket"), "bucket")
    y = x.select("bucket", F.col("k").alias("k_y"), F.col("root").alias("root_y"))
    return x.join(y, "bucket").where("root <> root_y and k < k_y").select(F.col("k").alias("a"), F.col("k_y").alias("b"))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions from each start to its end, and whose they are."""
    size = ends - starts
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + starts[owner], owner


def _block_links(
    named: DataFrame, sizes: DataFrame, sigs: DataFrame, texts: DataFrame, width: int, small: int, threshold: float, miss: float, block: int
) -> DataFrame:
    """Verified links between different components in buckets of more than ``small`` members, block by block.

    Every member goes, with its text, to each pair of blocks that has its own.
    """
    bounds = least_matches(threshold, miss)
    large = sizes.where(F.col("n") > small).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    x = named.select("bucket", "k", "root").join(large, "bucket").join(sigs, "k").join(texts, "k").withColumn("own", F.pmod(F.xxhash64("k", "bucket"), "blocks").cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "root", "sig", "text")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        left, right = (group[group["own"] == n] for n in (i, j))
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            shingle = Shingler(width)
            (mine, at), (theirs, to) = (shingle(side["text"].tolist()) for side in (left, right))
            a, b, least = _matrix(left["sig"]), _matrix(right["sig"]), bounds[0][1]
            ka, kb, ra, rb = left["k"].to_numpy(), right["k"].to_numpy(), left["root"].to_numpy(), right["root"].to_numpy()
            for n in range(len(a)):
                may = np.flatnonzero((rb != ra[n]) & (ka[n] < kb if i == j else True))
                may = may[(a[n, None, :BATCH] == b[may, :BATCH]).sum(1) >= least]
                may = may[_alive(np.broadcast_to(a[n], (len(may), SIGNATURE)), b[may], bounds)]
                if not len(may):
                    continue
                own = mine[at[n] : at[n + 1]]
                flat, owner = _ranges(to[may], to[may + 1])
                found = np.searchsorted(own, theirs[flat])
                both = np.bincount(owner[own[np.minimum(found, len(own) - 1)] == theirs[flat]], minlength=len(may))
                similar = may[both >= threshold * (len(own) + to[may + 1] - to[may] - both) - 1e-9]
                out += [(int(ka[n]), int(kb[m])) for m in similar[np.unique(rb[similar], return_index=True)[1]]]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs.min(1, initial=2**62), "b": pairs.max(1, initial=-(2**62))})

    return x.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")


def _both(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.col(a).alias("k")).union(pairs.select(F.col(b).alias("k"))).distinct()


def near_duplicate_rows(
    df: DataFrame, id_col: str = "row_id", set_col: str = "set_id", text_col: str = "verbatim_text",
    width: int = 5, threshold: float = 0.8, miss: float = 1e-3, small: int = 32, block: int = BLOCK, huge: int = HUGE, seed: int = 1,
) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their class ``k, k2``; classes with their group (``group_row_id, n_sets, n`` ...); the number of rows."""
    base = df.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(set_col).isNotNull(), F.xxhash64(F.lower(set_col))).otherwise(0).alias("set_hash"), F.col(text_col).alias("text")).where("id is not null")
    signed = stage(signatures(base, width, seed), "p1-signatures")
    known = F.when(F.col("set_hash") != 0, F.col("set_hash"))
    per_class = stage(
        signed.groupBy("k", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min(known).alias("s1"), F.max(known).alias("s2"), F.first("bands", True).alias("bands"), F.first("sig", True).alias("sig")),
        "p1-classes",
    )
    rows = stage(signed.select("id", "k", "k2"), "p1-rows")
    release(signed)
    total = first_value(per_class, F.coalesce(F.sum("n"), F.lit(0)))
    sigs = per_class.select(F.col("id").alias("k"), "sig")

    entries = stage(_met(per_class.select(F.col("id").alias("k"), F.explode("bands").alias("bucket"))), "p1-buckets")
    pairs = entries.where("k <> centre").select(F.least("k", "centre").alias("a"), F.greatest("k", "centre").alias("b")).distinct()

    def links(likely: DataFrame) -> DataFrame:
        ids = stage(_both(likely, "a", "b").withColumnRenamed("k", "id"), "p1-ids")
        # The ids of candidates go to the texts by broadcast only up to a checked number.
        texts = base.select("id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id").dropDuplicates(["id"])
        return stage(_verified(likely, texts.withColumnRenamed("id", "k"), width, threshold), "p1-links")

    tested = stage(_pruned(pairs, sigs, threshold, miss), "p1-likely")
    linked = links(tested)
    comps = components(linked)

    named = _named(entries.where("n > 2").select("bucket", "k"), comps)
    named = stage(named.join(_mixed(named), "bucket"), "p1-mixed")
    sizes = named.select("bucket", "n").distinct()
    is_huge = F.col("n") > huge
    finer = stage(_finer(named.where(is_huge).select("bucket", "k", "root"), sigs), "p1-finer")
    fine_sizes = _mixed(finer)
    close = _joined_pairs(named, sizes, small).unionByName(_joined_pairs(finer, fine_sizes, small)).distinct()
    likely = stage(_pruned(close, sigs, threshold, miss).join(tested, ["a", "b"], "left_anti"), "p1-likely")
    # The texts of large buckets' members; those of small ones follow with their pairs.
    members = stage(named.where(F.col("n") > small).select(F.col("k").alias("id")).distinct(), "p1-members")
    texts = base.select("id", "text").join(members, "id").dropDuplicates(["id"]).withColumnRenamed("id", "k")
    parts = [_block_links(x, n, sigs, texts, width, small, threshold, miss, block) for x, n in ((named.where(~is_huge), sizes.where(~is_huge)), (finer, fine_sizes))]
    more = stage(parts[0].unionByName(parts[1]).distinct(), "p1-links")
    if not likely.isEmpty():
        more = more.unionByName(links(likely))
    if not more.isEmpty():
        linked = stage(linked.unionByName(more).distinct(), "p1-all-links")
        comps = components(linked)

    classes_ = per_class.drop("bands", "sig").withColumnRenamed("id", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    grouped = classes_.groupBy("root").agg(F.min("rep").alias("group_row_id"), F.sum("n").alias("members"), F.min("s1").alias("s1"), F.max("s2").alias("s2"))
    degree = linked.select(F.col("a").alias("rep")).union(linked.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    groups = (
        classes_.select("k", "k2", "rep", "root", "n").join(grouped, "root").join(degree, "rep", "left")
        .select("k", "k2", "n", "group_row_id", "members", F.coalesce("links", F.lit(0)).alias("verified_links"), F.coalesce(F.col("s1") != F.col("s2"), F.lit(False)).alias("several_sets"))
    )
    return rows.select("id", "k", "k2"), groups, total


def groups(df: DataFrame, **options: object) -> DataFrame:
    """``group_row_id, row_id`` of all rows but the first of every group with at least two different set ids."""
    rows, by_class, total = near_duplicate_rows(df, **options)
    found = attach_groups(rows, by_class.where("several_sets").select("k", "k2", "n", "group_row_id"), ["k", "k2"], "n", total)
    return found.where("id <> group_row_id").select("group_row_id", F.col("id").alias("row_id"))


def classes(df: DataFrame, **options: object) -> DataFrame:
    """``row_id, group_row_id, members, verified_links``: every row that takes part, with its group and how many links of its text
    were verified to find that (members of one component are not compared further)."""
    rows, by_class, total = near_duplicate_rows(df, **options)
    found = attach_groups(rows, by_class.select("k", "k2", "n", "group_row_id", "members", "verified_links"), ["k", "k2"], "n", total)
    return found.select(F.col("id").alias("row_id"), "group_row_id", "members", "verified_links")


class Prefixes:
    """An exact similarity search over a block of sets, by prefix filter.

    All sets are ordered by how many sets of the block hold an element, rarest first. Two sets with a similarity of
    ``t`` share an element among the first ``n - ceil(t n) + 1`` of each.
    """

    def __init__(self, ids: np.ndarray, runs: np.ndarray, starts: np.ndarray, t: float) -> None:
        self.ids, self.runs, self.starts, self.t = ids, runs, starts, t
        self.elements, counts = np.unique(runs, return_counts=True)
        self.order = np.empty(len(counts), np.int64)
        self.order[np.lexsort((self.elements, counts))] = np.arange(len(counts))
        pairs = [(x, i) for i in range(len(ids)) for x in self._prefix(np.sort(self.order[np.searchsorted(self.elements, runs[starts[i] : starts[i + 1]])]), starts[i + 1] - starts[i])]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, first = np.unique(table[:, 0], return_index=True)
        self.first, self.owners = np.append(first, len(table)), table[:, 1]

    def _prefix(self, ranked: np.ndarray, size: int) -> np.ndarray:
        """Of the ranks of the known elements: those in the prefix. Unknown elements are rarer than all known ones."""
        room = int(size - np.ceil(self.t * size - 1e-9) + 1) - int(size - len(ranked))
        return ranked[: max(0, room)]

    def matches(self, own: np.ndarray) -> list[int]:
        """The places of the sets that are similar to one given as sorted, distinct elements."""
        at = np.searchsorted(self.elements, own)
        at = at[(at < len(self.elements)) & (self.elements[np.minimum(at, len(self.elements) - 1)] == own)]
        prefix = self._prefix(np.sort(self.order[at]), len(own))
        k = np.searchsorted(self.keys, prefix)
        k = k[(k < len(self.keys)) & (self.keys[np.minimum(k, len(self.keys) - 1)] == prefix)] if len(self.keys) else k[:0]
        found = []
        for i in {int(i) for x in k for i in self.owners[self.first[x] : self.first[x + 1]]}:
            other = self.runs[self.starts[i] : self.starts[i + 1]]
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both >= self.t * (len(own) + len(other) - both) - 1e-9:
                found.append(i)
        return found


def exact_links(df: DataFrame, id_col: str, text_col: str, width: int, threshold: float, every: int = 100, block: int = 5_000) -> DataFrame:
    """``a, b``: every row whose id is divisible by ``every``, with each other row that is similar to it, by exact search.

    The rows asked for go out in blocks of about ``block`` texts, each compared with all rows.
    """
    spark, base = df.sparkSession, df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    asked = base.where(F.col("id") % every == 0)
    slices, parts = max(1, -(-asked.count() // block)), []
    for n in range(slices):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == n).toPandas()
        runs, starts = Shingler(width)(got["text"].tolist())
        full = np.diff(starts) > 0
        if not full.any():
            continue
        sent = spark.sparkContext.broadcast(Prefixes(got["id"].to_numpy()[full], runs, np.append(starts[:-1][full], len(runs)), threshold))

        def search(batches: Iterator[pd.DataFrame], sent: Broadcast = sent) -> Iterator[pd.DataFrame]:
            index, shingle = sent.value, Shingler(width)
            for batch in batches:
                for lo in range(0, len(batch), 2000):
                    part = batch.iloc[lo : lo + 2000]
                    runs, starts = shingle(part["text"].tolist())
                    out = [(int(index.ids[i]), int(b)) for k, b in enumerate(part["id"]) if starts[k + 1] > starts[k] for i in index.matches(runs[starts[k] : starts[k + 1]]) if index.ids[i] != b]
                    yield pd.DataFrame(out, columns=["a", "b"])

        parts.append(base.mapInPandas(search, "a long, b long"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "a long, b long")


def recall(df: DataFrame, id_col: str = "row_id", text_col: str = "verbatim_text", width: int = 5, threshold: float = 0.8, every: int = 100, **options: object) -> DataFrame:
    """``asked, found, recall``: the links of every hundredth row by exact search, and how many lie within one group."""
    group = classes(df, id_col=id_col, text_col=text_col, width=width, threshold=threshold, **options).select("row_id", "group_row_id")
    group = stage(group, "p1-groups")
    true = stage(exact_links(df, id_col, text_col, width, threshold, every), "p1-exact")
    side = lambda c: group.select(F.col("row_id").alias(c), F.col("group_row_id").alias(f"{c}_group"))
    both = true.join(side("a"), "a").join(side("b"), "b")
    return both.agg(F.count("*").alias("asked"), F.count_if(F.col("a_group") == F.col("b_group")).alias("found")).withColumn("recall", F.coalesce(F.round(F.try_divide("found", "asked"), 6), F.lit(1.0)))
