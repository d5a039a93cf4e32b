import numpy as np

from quillspark.llm import neighbours as N

SCHEMA = "index_id long, urn_id string, indexed_at timestamp, v array<float>, id string, key int"


def table(spark, vectors, urns=None):
    from datetime import datetime

    urns = urns or [f"u{i}" for i in range(len(vectors))]
    return spark.createDataFrame([(i, u, datetime(2025, 1, 1 + i % 20), v, "x", 1) for i, (v, u) in enumerate(zip(vectors, urns))], SCHEMA)


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 20, dim))
    return (centres[r.integers(0, len(centres), n)] + 0.4 * r.normal(size=(n, dim))).astype(np.float32)


def exact(x, k=5):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    return {i: set(np.argsort(-s[i], kind="stable")[:k].tolist()) for i in range(len(x))}


def test_recall_with_partitions_and_blocks(spark):
    x = clustered(1200, 32, 1)
    df, truth = table(spark, x.tolist()), exact(x)
    for options in ({"part_rows": 150}, {"part_rows": 2000, "capacity": 200}):
        got = {}
        for r in N.top_neighbours(df, "v", 32, **options).collect():
            got.setdefault(r.id, set()).add(r.neighbour)
        assert np.mean([len(got[i] & truth[i]) / 5 for i in truth]) >= (0.9 if "capacity" not in options else 0.999)
        assert all(len(g) == 5 for g in got.values())


def test_two_levels_keep_copies_and_recall(spark):
    """A sample too small for enough partitions: the second level keeps them small, every vector goes to four places."""
    x = clustered(3000, 32, 5)
    y = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    router = N.TwoLevels(y[:600], 8, 8)
    to = router.route(y, 4)
    assert to.shape == (3000, 4) and all(len(set(r)) == 4 for r in to.tolist()) and to.max() < 64
    assert np.bincount(to[:, 0], minlength=64).max() < 3000 / 8
    df, truth, got = table(spark, x.tolist()), exact(x), {}
    for r in N.top_neighbours(df, "v", 32, part_rows=150, sample=100, most_sample=100).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert np.mean([len(got.get(i, set()) & truth[i]) / 5 for i in truth]) >= 0.9


def test_exact_and_recall_agree(spark):
    x = clustered(400, 16, 2)
    df, truth = table(spark, x.tolist()), exact(x)
    got = {}
    for r in N.exact_neighbours(df, "v", 16, every=10, block=12).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert got == {i: truth[i] for i in range(0, 400, 10)}
    row = N.recall(df, fields={"v": 16}, every=10).first()
    assert row.asked == 200 and row.recall >= 0.99


def test_unusable_and_stale_vectors_take_no_part(spark):
    good = clustered(40, 8, 3).tolist()
    bad = [None, [], [1.0] * 7, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7]
    df = table(spark, good + bad, [f"u{i % 30}" for i in range(40)] + [f"b{i}" for i in range(7)])
    pairs = N.neighbour_pairs(df, fields={"v": 8}).collect()
    used = {r.index_id_a for r in pairs} | {r.index_id_b for r in pairs}
    assert len(used) == 30 and max(used) < 40 and all(r.index_id_a < r.index_id_b for r in pairs)
    assert len(pairs) == len(set(pairs))


def test_equal_vectors_few_rows_and_empty(spark):
    df = table(spark, [[1.0, 2.0]] * 9)
    got = N.top_neighbours(df, "v", 2).collect()
    assert len(got) == 45 and all(abs(r.similarity - 1) < 1e-6 for r in got)
    assert N.neighbour_pairs(table(spark, [[1.0, 0.0]]), fields={"v": 2}).collect() == []
    assert N.neighbour_pairs(df.limit(0), fields={"v": 2}).collect() == []


def test_balanced_partitions():
    x = clustered(640, 16, 4)
    label = N.refine(N.bisect_balanced(x, 8, 1), N.nearest(x, 10), 8)
    size = np.bincount(label, minlength=8)
    assert size.max() <= 1.1 * 80 + 1 and size.min() > 0


def test_rows_without_an_id(spark):
    from datetime import datetime

    big = 2**60 + 1
    rows = [(i, f"u{k}", datetime(2025, 1, 1), [1.0, float(k)], "x", 1) for k, i in enumerate([None, big, big + 2, big + 4])]
    got = {(r.id, r.neighbour) for r in N.top_neighbours(spark.createDataFrame(rows, SCHEMA), "v", 2).collect()}
    assert got == {(a, b) for a in (big, big + 2, big + 4) for b in (big, big + 2, big + 4) if a != b}
