"""Vector functions: JVM expressions for arithmetic, vectorised Python only for the default embedder.

The default embedder is deterministic and needs no model: every word is a pseudo-random unit vector,
a text the normalised sum of its words. Any function of the same shape can take its place.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimensions of the three representations, and how many words of a text get a vector.
DIM, TOKEN_DIM, FDE_DIM, MAX_TOKENS = 768, 128, 1024, 48
BUCKETS = FDE_DIM // TOKEN_DIM


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null if a vector is null or lengths differ."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def maxsim(query: Column, document: Column) -> Column:
    """Mean over query vectors of the best cosine with a document vector; 0 for a document without vectors."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: cosine(q, d))))
    return F.when(F.size(document) > 0, F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query)).otherwise(F.lit(0.0))


def quantised_bucket(v: Column, buckets: int = BUCKETS) -> Column:
    """A bucket from the first four components to three decimals, the same for vectors that differ by rounding."""
    key = F.array_join(F.transform(F.slice(v, 1, 4), lambda x: F.round(x.cast("double") * 1000).cast("bigint").cast("string")), ",")
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 4), 16, 10).cast("bigint"), F.lit(buckets).cast("bigint"))


def exact_bucket(v: np.ndarray, buckets: int = BUCKETS) -> int:
    """A bucket from the bytes of the first four 32-bit components."""
    return int.from_bytes(hashlib.sha256(np.asarray(v[:4], np.float32).tobytes()).digest()[:2], "big") % buckets


def pooled_encoding(vectors: np.ndarray, bucket: np.ndarray | None = None) -> np.ndarray:
    """Fixed-dimensional encoding: vectors max-pooled by bucket, blocks and whole normalised; zeros for no vectors."""
    blocks = np.zeros((BUCKETS, TOKEN_DIM), np.float32)
    if len(vectors):
        bucket = np.array([exact_bucket(v) for v in vectors]) if bucket is None else bucket
        for b in np.unique(bucket):
            top = vectors[bucket == b].max(0)
            blocks[b] = top / (np.linalg.norm(top) or 1.0)
    flat = blocks.ravel()
    return flat / (np.linalg.norm(flat) or 1.0)


def pooled_by_bucket(df: DataFrame, keys: list[str], vector_col: str) -> DataFrame:
    """``keys, bucket, dim, pooled``: the vectors of each key max-pooled by bucket, for keys with any number of vectors."""
    each = df.select(*keys, quantised_bucket(F.col(vector_col)).alias("bucket"), F.posexplode(vector_col).alias("_p", "_x"))
    return each.groupBy(*keys, "bucket", (F.col("_p") + 1).cast("bigint").alias("dim")).agg(F.max(F.col("_x").cast("double")).alias("pooled"))


def word_vector(word: str, dim: int = DIM) -> np.ndarray:
    seed = int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=8).digest(), "big")
    v = np.random.default_rng(seed).standard_normal(dim, np.float32)
    return v / np.linalg.norm(v)


class HashedEmbedder:
    """``texts -> unit vectors``; words keep their vectors within a process, up to a bound."""

    def __init__(self, dim: int = DIM, keep: int = 50_000) -> None:
        self.dim, self.keep, self.known = dim, keep, {}

    def word(self, word: str) -> np.ndarray:
        if word not in self.known:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[word] = word_vector(word, self.dim)
        return self.known[word]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").split():
                out[i] += self.word(w)
            out[i] /= np.linalg.norm(out[i]) or 1.0
        return out


Embedder = Callable[[list[str]], np.ndarray]


def _lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as Arrow lists, without a Python object per number."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values, np.float32).ravel(), pa.float32()))


def _contents(embed: Embedder, values: list[str], batch: int) -> np.ndarray:
    """The vectors of whole texts."""
    whole = [embed(values[lo : lo + batch]) for lo in range(0, len(values), batch)]
    return np.concatenate(whole) if whole else np.zeros((0, DIM), np.float32)


def _words(embed: Embedder, values: list[str], batch: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The vectors of all words of some texts, and which of them each text has."""
    words = [t.split()[:MAX_TOKENS] for t in values]
    vocabulary = sorted({w for ws in words for w in ws})
    known = np.concatenate([embed(vocabulary[lo : lo + batch])[:, :TOKEN_DIM] for lo in range(0, len(vocabulary), batch)]) if vocabulary else np.zeros((0, TOKEN_DIM), np.float32)
    size = np.linalg.norm(known, axis=1, keepdims=True)
    known = known / np.where(size == 0, 1, size)
    place = {w: i for i, w in enumerate(vocabulary)}
    return known, [np.array([place[w] for w in ws], np.int64) for ws in words]


def _token_lists(known: np.ndarray, rows: list[np.ndarray]) -> pa.ListArray:
    starts = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    return pa.ListArray.from_arrays(starts, _lists(known[np.concatenate([np.zeros(0, np.int64), *rows])]))


def _encodings(known: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    bucket = np.array([exact_bucket(v) for v in known], np.int64)
    return np.stack([pooled_encoding(known[r], bucket[r]) for r in rows]) if rows else np.zeros((0, FDE_DIM), np.float32)


def represent(embedder: Callable[[], Embedder] = HashedEmbedder, batch: int = 64) -> Callable[[Column], Column]:
    """A function of a text column to ``struct<content_vector, token_vecs, fde>``.

    ``embedder`` makes the embedder once per Python worker. Words are embedded on their own, cut to 128
    components and normalised. A null text has no words.
    """

    @F.arrow_udf("struct<content_vector: array<float>, token_vecs: array<array<float>>, fde: array<float>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = embedder()
        for texts in parts:
            values = [t or "" for t in texts.to_pylist()]
            known, rows = _words(embed, values, batch)
            yield pa.StructArray.from_arrays([_lists(_contents(embed, values, batch)), _token_lists(known, rows), _lists(_encodings(known, rows))], ["content_vector", "token_vecs", "fde"])

    return run


def token_vectors(embedder: Callable[[], Embedder] = HashedEmbedder, batch: int = 64) -> Callable[[Column], Column]:
    """The ``token_vecs`` of ``represent`` alone."""

    @F.arrow_udf("array<array<float>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = embedder()
        for texts in parts:
            yield _token_lists(*_words(embed, [t or "" for t in texts.to_pylist()], batch))

    return run


def similarity(query: list[float], name: str, embedder: Callable[[], Embedder] = HashedEmbedder, batch: int = 64) -> Callable[[Column], Column]:
    """``dot`` of a constant vector and the ``content_vector`` or ``fde`` of a text, which never leaves the Python worker."""

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed, asked = embedder(), np.array(query, np.float64)
        for texts in parts:
            values = [t or "" for t in texts.to_pylist()]
            scores = [np.zeros(0)]
            for lo in range(0, len(values), 8 * batch):
                some = values[lo : lo + 8 * batch]
                made = _encodings(*_words(embed, some, batch)) if name == "fde" else _contents(embed, some, batch)
                # A running sum adds in the order of ``dot``, so both give the same bits.
                scores.append(np.cumsum(made.astype(np.float64) * asked, axis=1)[:, -1])
            yield pa.array(np.concatenate(scores))

    return run
