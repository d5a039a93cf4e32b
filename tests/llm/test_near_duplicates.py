import random
import re

from quillspark.llm import components as C
from quillspark.llm import near_duplicates as N

SCHEMA = "row_id long, set_id string, verbatim_text string, k int"


def shingles(t, width):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, width, threshold):
    s = {i: shingles(t, width) for i, _, t in rows}
    s = {i: x for i, x in s.items() if x}
    parent = {i: i for i in s}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in s:
        for b in s:
            if a < b and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    groups = {}
    for i in s:
        groups.setdefault(top(i), []).append(i)
    sets = {i: x.lower() if x else None for i, x, _ in rows}
    return sorted((min(g), i) for g in groups.values() for i in g if i != min(g) and len({sets[j] for j in g} - {None}) > 1)


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            w = r.choice(rows)[2].split()
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 1)] = r.choices(words, k=r.randint(0, 2))
        else:
            w = r.choices(words, k=r.randint(15, 60))
        rows.append((i, r.choice(["A", "a", "b", "C"]), " ".join(w) or "x"))
    return rows


def test_against_brute_force(spark):
    rows = [*corpus(300, 1), (900, "a", None), (901, "a", ""), (902, "b", "two words"), (903, None, "one two three"), (904, None, "one, two THREE")]
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA)
    got = sorted(map(tuple, N.groups(df, width=3, threshold=0.6).collect()))
    truth = brute(rows, 3, 0.6)
    assert set(got) <= set(truth) or len(set(got) - set(truth)) == 0
    assert len(set(got) & set(truth)) >= 0.98 * len(truth)


def test_large_buckets_are_split_and_finished(spark):
    """With a tiny bucket limit and tiny blocks the same links are found."""
    rows = corpus(150, 2)
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA)
    few, blocks, many = (sorted(map(tuple, N.groups(df, width=3, threshold=0.6, small=s, block=4, huge=h).collect())) for s, h in ((2, 9), (2, 1000), (64, 1000)))
    assert few == many == blocks


def hot(n, seed):
    """Variants of one text, too unlike to be linked; every tenth has a near copy."""
    r = random.Random(seed)
    base, rows = [f"t{i}" for i in range(100)], []
    for i in range(n):
        w = list(base)
        for j in r.sample(range(100), 3):
            w[j] = f"x{i}_{j}"
        rows.append((2 * i, "a", " ".join(w)))
        if i % 10 == 0:
            w[r.randrange(100)] = f"y{i}"
            rows.append((2 * i + 1, "b", " ".join(w)))
    return rows


def test_large_buckets_of_many_components_are_finished(spark):
    rows = hot(150, 4)
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA)
    assert sorted(map(tuple, N.groups(df, width=3, threshold=0.9, small=2, block=64, huge=100).collect())) == brute(rows, 3, 0.9)


def test_blocks_link_every_pair_of_different_components(spark):
    """Similar texts in one bucket: one link for each member and other component, whatever the size of blocks."""
    words = " ".join(f"w{i}" for i in range(60))
    named = spark.createDataFrame([(1, k, 38 if k == 39 else k) for k in range(40)], "bucket long, k long, root long")
    sigs = spark.createDataFrame([(k, bytes(range(64))) for k in range(40)], "k long, sig binary")
    texts = spark.createDataFrame([(k, f"{words} x{k}" if k != 7 else " ".join(f"z{i}" for i in range(61))) for k in range(40)], "k long, text string")
    sizes = named.groupBy("bucket").count().withColumnRenamed("count", "n")
    for block in (7, 4096):
        got = N._block_links(named, sizes, sigs, texts, 3, 32, 0.6, 1e-3, block).collect()
        every = {(a, b) for a in range(40) for b in range(a + 1, 40) if 7 not in (a, b)} - {(38, 39)}
        one_of = {(a, b) for a, b in every if b < 38}
        assert one_of <= set(map(tuple, got)) <= every


def test_triples_split_few_pairs():
    """The loss from splitting a large bucket is far below the miss probability of the verification."""
    assert len(N.TRIPLES) == 42 and all(len(set(t)) == 3 for t in N.TRIPLES)
    assert (1 - 0.6**3) ** len(N.TRIPLES) < 1e-4


def test_recall_and_exact_links(spark):
    rows = [(10 * i, s, t) for i, s, t in corpus(300, 7)] + [(5, "a", None), (7, "b", "")]
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA)
    sets = {i: x for i, _, t in rows if (x := shingles(t, 3))}
    true = {(a, b) for a in sets for b in sets if a % 20 == 0 and a != b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    for block in (7, 5000):
        assert set(map(tuple, N.exact_links(df, "row_id", "verbatim_text", 3, 0.6, every=20, block=block).collect())) == true
    r = N.recall(df, width=3, threshold=0.6, every=20).first()
    assert r.asked == len(true) and r.found >= 0.99 * r.asked
    assert N.recall(df.limit(0)).first().recall == 1.0


def test_a_hub_keeps_all_its_links(spark):
    links = spark.range(1, 20_000).selectExpr("0L as a", "id as b").unionByName(spark.range(20_000, 20_010).selectExpr("id as a", "id - 19990 as b"))
    got = C.components(links)
    assert got.count() == 20_009 and got.where("root <> 0").count() == 0


def test_equal_texts_and_empty_table(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "same words in every one of these texts here", 1) for i in range(50)], SCHEMA)
    assert sorted(map(tuple, N.groups(df).collect())) == [(0, i) for i in range(1, 50)]
    assert {(r.group_row_id, r.members) for r in N.classes(df).collect()} == {(0, 50)}
    assert N.groups(df.limit(0)).collect() == []


def test_least_matches_never_prunes_sure_pairs():
    assert all(m < n * 0.6 for n, m in N.least_matches(0.6, 1e-3))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 301), (301, 302), (302, 300)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 301: 300, 302: 300}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hot_buckets_have_one_centre(spark):
    """A bucket with a third of all entries is salted and still has one centre and one size."""
    entries = spark.range(9_000).selectExpr("id as k", "if(id % 3 = 0, 5L, xxhash64(id div 6)) as bucket")
    got = N._met(entries)
    assert got.where("bucket = 5").count() == 3000 and [tuple(r) for r in got.where("bucket = 5").groupBy("centre", "n").count().select("n", "count").collect()] == [(3000, 3000)]
    assert got.where("bucket <> 5").groupBy("bucket").agg({"n": "max", "k": "count", "centre": "min"}).where("`max(n)` <> `count(k)`").count() == 0


def test_rows_without_an_id(spark):
    same = "same words in every one of these texts here"
    big = 2**60 + 1
    df = spark.createDataFrame([(None, "a", same, 1), (big, "a", same, 1), (big + 2, None, same, 1), (big + 4, "b", same, 1)], SCHEMA)
    assert sorted(map(tuple, N.groups(df).collect())) == [(big, big + 2), (big, big + 4)]
