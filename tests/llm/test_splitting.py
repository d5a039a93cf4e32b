import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import splitting as S


def reference_level(t, limit):
    import re

    def within(units):
        return all(len(u.strip()) <= limit for u in units)

    paragraphs = re.split(r"\n[^\S\n]*\n", t)
    if within(paragraphs):
        return "paragraph"
    if within(s for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p)):
        return "sentence"
    return "word" if within(t.split()) else "character"


def check(text, pieces, limit, overlap):
    """Pieces are within the limit, in order, overlap at most so much, and leave out nothing but white space."""
    assert text[: pieces[0][0]].strip() == "" and text[pieces[-1][1] :].strip() == ""
    for a, b, _ in pieces:
        assert 0 < b - a <= limit
    for (_, b, _), (a2, b2, _) in zip(pieces, pieces[1:]):
        assert b2 > b and a2 >= b - overlap and text[b : max(a2, b)].strip() == ""


def ranged(text, limit, overlap, size, halo):
    """The pieces of a text by ranges of a size, as the operator goes about it: transfers, states, pieces."""
    seen = list(enumerate(S.views(text, size, halo)))
    rows = [(1, 0, part, v.base, v.n, *map(list, zip(*S.Cutter(v, limit, overlap, halo).transfers()))) for part, v in seen]
    rows = [r if len(r) == 9 else (*r[:5], [], [], [], []) for r in rows]
    table = pd.DataFrame(rows, columns=[x.split()[0] for x in S.TRANSFERS.split(", ")])
    halves = [table.iloc[: len(table) // 2], table.iloc[len(table) // 2 :]]
    states = {r.part: r for f in S._follow(iter(halves)) for r in f.itertuples()}
    return [x for part, v in seen if part in states for x in S._emitted(S.Cutter(v, limit, overlap, halo), states[part].begin, states[part].piece)]


def whole(text, limit, overlap, halo):
    v = next(S.views(text, max(1, len(text)), halo))
    return list(S._emitted(S.Cutter(v, limit, overlap, halo), -1, 0))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb. ", "c! ", "ddd ", "\n", "\n\n", " \r\n", "e" * 7, "f" * 60, "g" * 200, " " * 30, " " * 100, "\n" * 45, "é"]), min_size=1, max_size=60), st.sampled_from([7, 50, 64, 130, 1000]))
def test_pieces_do_not_depend_on_the_ranges(parts, size):
    text = "".join(parts)
    one = whole(text, 40, 10, 80)
    assert ranged(text, 40, 10, size, 80) == one
    assert [x[0] for x in one] == list(range(len(one))) and all(text[a:b] == t for _, a, b, _, t in one)
    if text.strip():
        check(text, [x[1:4] for x in one], 40, 10)
    else:
        assert not one


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .!\n\xa0", min_size=41, max_size=400))
def test_pieces_of_any_text(text):
    one = whole(text, 40, 10, 800)
    assert ranged(text, 40, 10, 50, 800) == one
    if text.strip():
        check(text, [x[1:4] for x in one], 40, 10)


def document(seed, size):
    r = random.Random(seed)
    out = []
    while sum(map(len, out)) < size:
        out += ["".join(r.choices("abcdeé", k=r.randint(1, 12))), r.choice([" ", " ", " ", ". ", "! ", "\n\n", " "])]
    return "".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_ranges_stitch_to_the_same_level(spark, seed):
    text = document(seed, 3000)
    df = spark.createDataFrame([(1, text), (2, text[:900]), (3, None), (4, "")], "row_id long, verbatim_text string")
    whole = {r.row_id: r.boundary for r in S.boundary_levels(df, limit=60, range_chars=100_000).collect()}
    ranged = {r.row_id: r.boundary for r in S.boundary_levels(df, limit=60, range_chars=500, halo=200).collect()}
    assert whole == ranged == {i: reference_level(t, 60) for i, t in ((1, text), (2, text[:900]))}


def test_pieces_of_ranges_and_of_whole_texts(spark):
    text = document(9, 4000)
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (1, text), (1, document(8, 900))], "row_id long, verbatim_text string")
    got = {}
    for size in (65_536, 512, 100):
        rows = S.pieces_of_table(df, limit=60, overlap=10, range_chars=size, halo=4096).collect()
        got[size] = sorted(map(tuple, rows))
        first = [r for r in rows if r.row_id == 1 and r.text == text[r.start : r.stop]]
        assert {r.row_id for r in rows} == {1} and len({r.piece for r in first}) * 2 <= len(first)
    assert got[65_536] == got[512] == got[100]
    once = sorted({(r[1], r[2], r[3]) for r in got[512] if r[5] == text[r[2] : r[3]]})
    check(text, [x[1:] + (0,) for x in once], 60, 10)


@pytest.mark.parametrize("run", [" " * 300, "\n\n" + " " * 900, " " * 900 + "\n\n", " " * 2500, " " * 100 + "\n" * 30])
def test_long_white_space_across_a_range_boundary(spark, run):
    """Runs shorter and longer than the halo and than a range: no unit is left out."""
    texts = {}
    for i, lead in enumerate((0, 1, 380, 440, 470, 490, 499)):
        text = (document(i, 600)[:lead].rstrip() + "x." if lead else "") + run + "after " * 9 + "\n\n" + document(i + 50, 1500)
        texts[i] = text + run * (i % 2)
    df = spark.createDataFrame(list(texts.items()), "row_id long, verbatim_text string")
    got = S.pieces_of_table(df, limit=60, overlap=10, range_chars=500, halo=200).orderBy("row_id", "piece").collect()
    for i, text in texts.items():
        own = [r for r in got if r.row_id == i]
        assert [r.piece for r in own] == list(range(len(own))) and all(r.text == text[r.start : r.stop] and r.text.strip() for r in own)
        check(text, [(r.start, r.stop, 0) for r in own], 60, 10)


def test_one_endless_word(spark):
    df = spark.createDataFrame([(1, "é" * 5000)], "row_id long, verbatim_text string")
    assert S.boundary_levels(df).first().boundary == "character"
    for options in ({}, {"range_chars": 2100, "halo": 2100}):
        got = S.pieces_of_table(df, **options).orderBy("piece").collect()
        check("x" * 5000, [(r.start, r.stop, 0) for r in got], 1000, 120)


def test_files_by_byte_ranges(spark, tmp_path):
    text = document(5, 60_000)
    (tmp_path / "a.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "b.txt").write_text("tiny", encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    got = S.pieces_of_files(spark, f"file://{tmp_path}", limit=200, overlap=30, range_bytes=7001, halo=800).collect()
    own = sorted((r.piece, r.start, r.stop, r.text) for r in got if r.path.endswith("a.txt"))
    assert own == [(k, a, b, t) for k, a, b, _, t in whole(text, 200, 30, 800)]
    assert all(t == text[a:b] for _, a, b, t in own)
    check(text, [(a, b, 0) for _, a, b, _ in own], 200, 30)
    assert [r.text for r in got if r.path.endswith("b.txt")] == ["tiny"]


def test_files_written_from_a_table(spark):
    df = spark.createDataFrame([(i, document(i, 700)) for i in range(20)] + [(99, None)], "row_id long, verbatim_text string").coalesce(2)
    got = S.pieces_of_files(spark, S.files_of_table(df), limit=60, overlap=10, range_bytes=1000, halo=400).collect()
    words = sum(len(document(i, 700).split()) for i in range(20))
    assert len({r.path for r in got}) == 2 and all(len(r.text) <= 60 for r in got)
    assert sum(len(r.text.split()) for r in got) >= words


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, verbatim_text string")
    assert S.boundary_levels(df).collect() == [] and S.pieces_of_table(df).collect() == []


def test_rows_without_an_id(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(None, "word " * 50), (big, "word " * 50), (big + 2, "word " * 400)], "row_id long, verbatim_text string")
    assert {r.row_id for r in S.boundary_levels(df, limit=60).collect()} == {big, big + 2}
    assert {r.row_id for r in S.pieces_of_table(df, limit=60, overlap=10, range_chars=500).collect()} == {big, big + 2}
