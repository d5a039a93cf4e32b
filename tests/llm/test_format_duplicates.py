import random
import re

import pytest

from quillspark.llm import format_duplicates as D

SCHEMA = "row_id long, verbatim_text string, id int, h1 string, keep int"


def found(spark, texts):
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return sorted((r.keep_row_id, r.copy_row_id) for r in D.copies(df).collect())


@pytest.mark.parametrize(
    ("texts", "pairs"),
    [
        (["Take  2.5 mg!", "take 2.5 MG", "take 25 mg", "take 2 5 mg", "take 2,5 mg"], [(0, 1)]),
        (["A: 1; B: 2; C: 3", "c: 3 | a: 1 | b: 2", "C: 1; A: 3; B: 2"], [(0, 1)]),
        (["A: 1\nB: 2\nC: 3", "a 1, b 2, c 3", "b 2 a 1 c 3"], [(0, 1)]),
        (["A: 1; B: 2", "B: 2; A: 1"], []),
        (["a b", "A b", "a\tb."], [(0, 1), (0, 2)]),
        ([None, "", "  ", "...", None], []),
        ([], []),
        (["x y"] * 3, [(0, 1), (0, 2)]),
        (["A B: 1; C: 2; D: 3", "C: 2; A: B 1; D: 3"], []),
        (["A: B 1; C: 2; D: 3", "C: 2; A: B 1; D: 3"], [(0, 1)]),
        (["A: 1; B: 2; C: 3; D: 4", "A: 1; B: 2 C: 3; D: 4", "D: 4; C: 3; B: 2; A: 1", "D: 4; B: 2 C: 3; A: 1"], [(0, 1), (0, 2), (0, 3)]),
        (["D: 4; B: 2 C: 3; A: 1", "D: 4; C: 3; B: 2; A: 1"], []),
    ],
)
def test_cases(spark, texts, pairs):
    assert found(spark, texts) == pairs


def test_very_long_text(spark):
    assert found(spark, ["word " * 300_000, "WORD\n" * 300_000]) == [(0, 1)]
    assert found(spark, ["a" + "-.,;" * 100_000 + "b", "a b", "a: b " * 100_000, "a; b " * 100_000]) == [(0, 1), (2, 3)]


def brute(texts):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def words(t):
        t = re.sub(r"(?<=\d)([.,])(?=\d)", lambda m: "" if m.group() == "." else "", t.lower())
        return re.findall(r"(?:[^\W_]|[])+", t)

    for i, t in enumerate(texts):
        if words(t):
            parent[top(("i", i))] = top(("s", " ".join(words(t))))
            parts = [p for p in re.split(r"[;|\n\r]+", t) if words(p)]
            if len(parts) >= 3 and all(":" in p and 1 <= len(words(p.split(":")[0])) <= 3 and words(p.split(":", 1)[1]) for p in parts):
                parent[top(("i", i))] = top(("f", tuple(sorted(" ".join(words(p)) for p in parts))))
    groups = {}
    for x in list(parent):
        if x[0] == "i":
            groups.setdefault(top(x), []).append(x[1])
    return sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


def test_against_brute_force(spark):
    r = random.Random(3)
    texts = []
    for _ in range(400):
        fields = [f"{r.choice(['Dose', 'Route of use', 'Form', 'Form oral'])}: {r.choice(['2.5 mg', '25 mg', 'oral', 'oral 25 mg'])}" for _ in range(r.randint(1, 4))]
        t = "".join(f + r.choice(["; ", " | ", "\n", ", "]) for f in fields)
        texts.append(r.choice([str.upper, str.lower, lambda x: x.replace(" ", "  "), lambda x: x + "."])(t))
    assert found(spark, texts) == brute(texts)


def test_records_and_collisions(spark):
    df = spark.createDataFrame([(5, "a b"), (3, "A, b"), (9, "c"), (1, None)], "row_id long, verbatim_text string")
    assert sorted((r.keep_row_id, r.copies) for r in D.records(df).collect()) == [(3, 2), (9, 1)]
    assert D.collisions(df).first().n_collisions == 0


def test_hot_group_keeps_all_rows(spark):
    df = spark.range(30_000).selectExpr("id as row_id", "if(id % 3 = 0, 'same  text', concat('t ', id)) as verbatim_text")
    assert D.copies(df).count() == 9_999
