import random

import pytest

from quillspark.llm import mixing as M


def test_apportionment_is_by_highest_quotients():
    assert M.sainte_lague([0.53, 0.24, 0.23], [99] * 3, 7) == [3, 2, 2]
    assert M.sainte_lague([0.5, 0.5], [1, 99], 9) == [1, 8]
    assert M.sainte_lague([0.5, 0.0], [9, 9], 20) == [9, 0]
    assert M.sainte_lague([], [], 3) == [] and M.sainte_lague([0.0], [5], 3) == [0]
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 6)
        w, c, seats = [r.random() for _ in range(n)], [r.randint(0, 30) for _ in range(n)], r.randint(0, 90)
        got = [0] * n
        for _ in range(min(seats, sum(c))):
            i = max((i for i in range(n) if got[i] < c[i]), key=lambda i: w[i] / (2 * got[i] + 1))
            got[i] += 1
        assert M.sainte_lague(w, c, seats) == got


DOCS = "doc_id long, text string, source string, tokens int, shard string"
TARGETS = "source string, target_share double, max_repeats int, extra string"


def mix(spark, docs, targets, **options):
    return M.mixed(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), block_tokens=60, **options)


def test_shares_and_repeats(spark):
    r = random.Random(2)
    docs = [(i, "some words " * r.randint(1, 20), r.choice(["Big-one", "big_one ", "BIG_ONE"] * 3 + ["small"]), 0, "x") for i in range(1500)]
    docs += [(2000, None, "small", 0, "x"), (2001, "", "small", 0, "x"), (2002, "text", None, 0, "x"), (2003, "text", "untargeted", 0, "x")]
    targets = [("big_one", 0.5, 1, "e"), ("small", 0.4, 3, "e"), ("missing", 0.1, 4, "e")]
    mixture, report = mix(spark, docs, targets)
    got = {x.source: x for x in report.collect()}
    assert got["missing"].reached_share == 0 and got["missing"].at_limit
    assert got["big_one"].reached_share == pytest.approx(0.5 / 0.9, abs=0.02) and got["small"].reached_share == pytest.approx(0.4 / 0.9, abs=0.02)
    rows = mixture.collect()
    assert len({x.doc_id for x in rows}) == len(rows) and all(x.times <= {"big_one": 1, "small": 3}[x.source] for x in rows)
    assert sum(x.tokens * x.times for x in rows if x.source == "small") == got["small"].used_tokens
    again = sorted(map(tuple, mix(spark, docs, targets)[0].collect()))
    assert again == sorted(map(tuple, rows)) and again != sorted(map(tuple, mix(spark, docs, targets, seed=9)[0].collect()))


def test_shards_and_unreachable_total(spark):
    docs = [(i, "alpha beta gamma " * 5, "ab"[i % 2], 0, "x") for i in range(400)]
    mixture, report = mix(spark, docs, [("a", 0.9, 1, ""), ("b", 0.1, 1, "")], total_tokens=10**9, shard_tokens=500)
    assert {x.source: x.at_limit for x in report.collect()} == {"a": True, "b": True}
    assert mixture.count() == 400 and mixture.agg({"times": "max"}).first()[0] == 1


def test_empty_tables(spark):
    mixture, report = mix(spark, [], [("a", 1.0, 1, "")])
    assert mixture.collect() == [] and [x.reached_share for x in report.collect()] == [0.0]


def test_rows_without_an_id(spark):
    big = 2**60 + 1
    mixture, _ = mix(spark, [(None, "some words", "a", 0, "x"), (big, "some words", "a", 0, "x")], [("a", 1.0, 1, "")])
    assert [r.doc_id for r in mixture.collect()] == [big]
