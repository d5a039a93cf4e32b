"""Problem 4: the most similar vectors of every vector, by learned partitions.

A neighbour graph over a bounded sample is cut into balanced partitions (recursive bisection, then
capacity-bound moves that keep neighbours together). A small softmax classifier learns to tell a
vector's partition; it routes every vector of the collection to its ``probes`` most probable
partitions, in which all members are ranked by exact cosine. Vectors travel as 16-bit integers.

Where the sample can't carry enough partitions for ``part_rows`` vectors each, a second router, fitted on the
differences of the sample from the means of their partitions, splits every partition into the same number of
parts; a vector goes to the most probable pairs of partition and part. So it is sent to ``probes`` places (twice
as many with two levels), however many vectors there are.

A partition larger than ``capacity`` is split into blocks, and each pair of blocks is one bounded
task, so no partition, however hot, is held by one task, and none of its members is left out.

Only the fitting uses a sample: about 16 vectors per partition, ``sample`` (2,000) at least and ``most_sample``
(50,000) at most, drawn by a hash of the id. All vectors are indexed and all are queries.

Defined results: of each ``urn_id`` the row with the latest ``indexed_at`` counts, the greater id on
ties; a row with a null ``urn_id`` stands for itself. Vectors that are null, of another length, all
zero or hold NaN, infinity or null take no part, nor do rows without an id. Equal vectors are neighbours with similarity 1, ordered by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import stage

FIELDS = {"content_vector": 768, "muvera_fde": 1024}
#: A list of ids of up to this length is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 2_000_000


def current_rows(df: DataFrame, id_col: str, key_col: str, time_col: str) -> DataFrame:
    """The latest row of every key, without moving the other columns where few rows are stale."""
    ids = df.select(F.col(id_col).alias("id"), F.coalesce(key_col, F.concat(F.lit("\u0001"), F.col(id_col).cast("string"))).alias("key"), F.col(time_col).alias("t"))
    latest = ids.groupBy("key").agg(F.max_by("id", F.struct("t", "id")).alias("id"))
    stale = stage(ids.select("id").join(latest.select("id"), "id", "left_anti"), "p4-stale").withColumnRenamed("id", id_col)
    return df.join(F.broadcast(stale) if stale.count() <= BROADCAST_IDS else stale, id_col, "left_anti")


def unit_vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit-length float32 vectors of the usable rows of an ``id, v`` batch."""
    ids, lists = np.asarray(batch.column(0)), batch.column(1)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", values, values, dtype=np.float64))
    good = np.isfinite(norm) & (norm > 0)
    return ids[good], (values[good] / norm[good, None]).astype(np.float32)


def bisect_balanced(x: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Labels of ``parts`` (a power of two) equal parts, by median cuts along the leading direction."""
    label, r = np.zeros(len(x), np.int64), np.random.default_rng(seed)
    for _ in range(int(math.log2(parts))):
        fresh = label * 2
        for p in np.unique(label):
            at = np.flatnonzero(label == p)
            y = x[at] - x[at].mean(0)
            v = r.normal(size=x.shape[1]).astype(np.float32)
            for _ in range(15):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) + 1e-12
            order = np.argsort(y @ v, kind="stable")
            fresh[at[order[len(at) // 2 :]]] += 1
        label = fresh
    return label


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def refine(label: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, sweeps: int = 4) -> np.ndarray:
    """Moves nodes to the part most of their neighbours are in, as long as that part has room."""
    label, room = label.copy(), math.ceil(slack * len(label) / parts)
    size = np.bincount(label, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for i in range(len(label)):
            near = np.bincount(label[graph[i]], minlength=parts)
            best = int(near.argmax())
            if near[best] > near[label[i]] and size[best] < room:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


class Router:
    """The classifier: a projection to leading directions and a softmax layer."""

    def __init__(self, sample: np.ndarray, parts: int, dims: int = 128, seed: int = 1) -> None:
        self.parts = parts
        dims = min(dims, sample.shape[1])
        self.mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1], np.float32)
        y = sample - self.mean
        _, vectors = np.linalg.eigh((y.T @ y).astype(np.float32))
        self.basis = np.ascontiguousarray(vectors[:, -dims:]).astype(np.float32)
        self.weights, self.bias = np.zeros((dims, parts), np.float32), np.zeros(parts, np.float32)
        if parts > 1:
            z = y @ self.basis
            unit = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-9)
            self.scale = float(1 / (z.std() + 1e-9))
            self._fit(z * self.scale, refine(bisect_balanced(unit, parts, seed), nearest(unit, 10), parts), seed)
        else:
            self.scale = 1.0

    def _fit(self, z: np.ndarray, label: np.ndarray, seed: int, epochs: int = 30, size: int = 256, rate: float = 0.02) -> None:
        r = np.random.default_rng(seed)
        state = [np.zeros_like(x) for x in (self.weights, self.weights, self.bias, self.bias)]
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(z))
            for lo in range(0, len(z), size):
                at = order[lo : lo + size]
                p = z[at] @ self.weights + self.bias
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(at)), label[at]] -= 1
                step += 1
                for w, g, m, v in ((self.weights, z[at].T @ p / len(at) + 1e-4 * self.weights, *state[:2]), (self.bias, p.mean(0), *state[2:])):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the partitions."""
        s = ((x - self.mean) @ self.basis) * self.scale @ self.weights + self.bias
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable partitions of each vector, best first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :probes]


class TwoLevels:
    """A router to partitions, and one within them that all partitions share."""

    def __init__(self, sample: np.ndarray, parts: int, inner: int, seed: int = 1) -> None:
        self.outer, self.parts, self.inner = Router(sample, parts, seed=seed), parts * inner, None
        if inner > 1:
            at = self.outer.route(sample, 1)[:, 0]
            sums = np.zeros((parts, sample.shape[1]), np.float64)
            np.add.at(sums, at, sample)
            self.means = (sums / np.maximum(np.bincount(at, minlength=parts), 1)[:, None]).astype(np.float32)
            self.inner = Router(self._rest(sample, at), inner, seed=seed + 1)

    def _rest(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        y = x - self.means[part]
        return y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-9)

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable pairs of a partition (of the ``probes`` best) and a part of it, best first."""
        if self.inner is None:
            return self.outer.route(x, probes)
        s, n = self.outer.scores(x), self.inner.parts
        best = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        both = [np.take_along_axis(s, best[:, k : k + 1], 1) + self.inner.scores(self._rest(x, best[:, k])) for k in range(best.shape[1])]
        flat = np.concatenate(both, 1)
        top = np.argsort(-flat, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(best, top // n, 1) * n + top % n


def _vectors(df: DataFrame, id_col: str, field: str, dim: int) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(field).cast("array<float>").alias("v")).where((F.size("v") == dim) & F.col("id").isNotNull())


def _fit(vectors: DataFrame, dim: int, count: int, parts: int, inner: int, sample: int, seed: int) -> TwoLevels:
    taken = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, count))) < sample)
    batches = [unit_vectors(b, dim)[1] for b in taken.toArrow().to_batches()]
    return TwoLevels(np.concatenate(batches) if batches else np.zeros((0, dim), np.float32), parts, inner, seed)


def top_neighbours(
    df: DataFrame, field: str, dim: int, id_col: str = "index_id", k: int = 5, probes: int = 2, part_rows: int = 2000, capacity: int = 8000, sample: int = 2_000, most_sample: int = 50_000, seed: int = 1
) -> DataFrame:
    """``id, neighbour, similarity`` of (about) the ``k`` most similar others of every usable vector of ``df``."""
    spark, vectors = df.sparkSession, _vectors(df, id_col, field, dim)
    count = vectors.select("id").count()
    wanted = 1 << max(0, math.ceil(math.log2(max(1, count) / part_rows)))
    # The classifier needs some sampled vectors of every partition; beyond that, a second level splits them.
    sample = min(most_sample, max(sample, 16 * wanted))
    outer = min(wanted, max(1, 1 << int(math.log2(max(1, min(sample, count) // 8)))))
    inner = min(outer, wanted // outer)
    parts = outer * inner
    router = spark.sparkContext.broadcast(_fit(vectors, dim, count, outer, inner, sample, seed) if count else None)
    probes = min(probes * (2 if inner > 1 else 1), parts)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, n = np.unique(router.value.route(unit_vectors(batch, dim)[1], probes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.int64())], ["part", "n"])

    held = vectors.mapInArrow(sizes, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > capacity)
    blocks = {r.part: math.ceil(r.n / capacity) for r in held.toLocalIterator()}
    schema = "part int, i int, j int, role int, id long, q binary"

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                ids, x = unit_vectors(batch.slice(lo, 500), dim)
                if not len(ids):
                    continue
                to = router.value.route(x, probes)
                q = np.rint(x * 32767).astype(np.int16)
                out: list[tuple] = []
                for n, (i, near) in enumerate(zip(ids.tolist(), to.tolist())):
                    data = q[n].tobytes()
                    for p in near:
                        s = blocks.get(p, 1)
                        if s == 1:
                            out.append((p, 0, 0, 3, i, data))
                        else:
                            own = (i * 2654435761 >> 7) % s
                            out += [(p, own, j, 3 if j == own else 1, i, data) for j in range(s)]
                            out += [(p, j, own, 2, i, data) for j in range(s) if j != own]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["part", "i", "j", "role", "id", "q"])

    def ranked(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group["q"]), np.int16).reshape(-1, dim).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, role = group["id"].to_numpy(), group["role"].to_numpy()
        ask, base = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        b, order_ids, out = x[base], ids[base], []
        for lo in range(0, len(ask), 1024):
            at = ask[lo : lo + 1024]
            s = x[at] @ b.T
            s[ids[at][:, None] == order_ids[None, :]] = -2
            m = min(k, len(base))
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            out.append(pd.DataFrame({"id": np.repeat(ids[at], m), "neighbour": order_ids[best].ravel(), "similarity": np.take_along_axis(s, best, 1).ravel()}))
        got = pd.concat(out) if out else pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        return got[got["similarity"] > -2]

    found = vectors.mapInArrow(routed, schema).groupBy("part", "i", "j").applyInPandas(ranked, "id long, neighbour long, similarity double")
    once = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_pairs(df: DataFrame, id_col: str = "index_id", key_col: str = "urn_id", time_col: str = "indexed_at", fields: dict[str, int] = FIELDS, **options: int) -> DataFrame:
    """``field, index_id_a, index_id_b``: each pair of which one is among the most similar of the other."""
    now = current_rows(df, id_col, key_col, time_col)
    found = [top_neighbours(now, f, d, id_col, **options).select(F.lit(f).alias("field"), F.least("id", "neighbour").alias("index_id_a"), F.greatest("id", "neighbour").alias("index_id_b")) for f, d in fields.items()]
    return reduce(DataFrame.unionByName, found).distinct()


def exact_neighbours(df: DataFrame, field: str, dim: int, id_col: str = "index_id", k: int = 5, every: int = 100, block: int = 4000) -> DataFrame:
    """``id, neighbour, similarity`` by brute force, for the rows whose id is divisible by ``every``.

    The queries go out in blocks of at most ``block`` vectors, each compared with all rows.
    """
    spark, vectors = df.sparkSession, _vectors(df, id_col, field, dim)
    asked = vectors.where(F.col("id") % every == 0)
    slices = max(1, math.ceil(asked.count() / (0.75 * block)))
    parts = []
    for n in range(slices):
        got = [unit_vectors(b, dim) for b in asked.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == n).toArrow().combine_chunks().to_batches()]
        if not got:
            continue
        sent = spark.sparkContext.broadcast((np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])))

        def compare(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                base, x = unit_vectors(batch, dim)
                if not len(base):
                    continue
                s = q @ x.T
                s[ids[:, None] == base[None, :]] = -2
                m = min(k, len(base))
                best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(base[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel().astype(float))], ["id", "neighbour", "similarity"])

        parts.append(vectors.mapInArrow(compare, "id long, neighbour long, similarity double"))
    if not parts:
        return spark.createDataFrame([], "id long, neighbour long, similarity double, rank int")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return reduce(DataFrame.unionByName, parts).where("similarity > -2").withColumn("rank", rank).where(F.col("rank") <= k)


def recall(df: DataFrame, id_col: str = "index_id", key_col: str = "urn_id", time_col: str = "indexed_at", fields: dict[str, int] = FIELDS, every: int = 100, **options: int) -> DataFrame:
    """``field, asked, recall``: the share of the exact neighbours of every hundredth row that the index finds."""
    now = current_rows(df, id_col, key_col, time_col)
    out = []
    for f, d in fields.items():
        exact, found = exact_neighbours(now, f, d, id_col, every=every), top_neighbours(now, f, d, id_col, **options)
        both = exact.select("id", "neighbour").join(found.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
        out.append(both.agg(F.lit(f).alias("field"), F.count("*").alias("asked"), F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*"), 4).alias("recall")))
    return reduce(DataFrame.unionByName, out)
