import pytest

from quillspark.llm import truncation as T

WHOLE = ["Take the tablet with a glass of water every morning.", "The trial closed after three visits in most patients.", "Ask your doctor about any pain in the chest or the arm."]


@pytest.mark.parametrize(
    ("text", "core", "marked"),
    [("abc...", "abc", True), ("abc [...] ", "abc", True), ("abc�</div>\n", "abc", True), ("abc.", "abc.", False), ("abc <", "abc", True), ("done.</p>", "done.", False), ("a…", "a", True), ("a" + "<b x='" + "y" * 300 + "'>", "a", False), ("a <i class='" + "y" * 300, "a", True), ("a > b", "a > b", False)],
)
def test_core(text, core, marked):
    assert T.core_of(text) == (core, marked)


def test_core_of_long_runs():
    assert T.core_of("a" + " " * 500_000 + "b") == ("a" + " " * 500_000 + "b", False)
    assert T.core_of("abc" + "." * 50_000 + " \n" * 50_000) == ("abc", True)


def corpus():
    docs = []
    for i in range(120):
        body = f"Note {i} begins. " + " ".join(WHOLE[(i + j) % 3] for j in range(3))
        ending = ["", "\n\nRx only", "\n\n* pain in the chest\n* pain in the arm", "\n\n| a | 1 | daily |\n| b | 2 | weekly |", "\n\nSource: file 12, page 3, 2025"][i % 5]
        docs.append([i, body + ending, ["a-b", "A_B ", None][i % 3], 0])
    return docs


CUT = {1000: "Take the tablet with a glass of water every mor", 1001: WHOLE[0] + " The trial closed after", 1002: WHOLE[0] + "\n\n| a | 1 | daily |\n| b | 2", 1003: WHOLE[0] + "\n\n* pain in the", 1004: WHOLE[1] + " Ask your doctor about any…", 1005: WHOLE[1] + " Ask your do</div>"}
FINE = {2000: None, 2001: "", 2002: "...", 2003: WHOLE[0] + " (see below.)", 2004: "<div>" + WHOLE[1] + "</div>", 2005: WHOLE[2] + "\n\nRx only"}


def test_cut_texts_are_found(spark):
    docs = corpus() + [[i, t, "a_b", 0] for i, t in (CUT | FINE).items()]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, word int")
    assert sorted(r.doc_id for r in T.judged(df).collect()) == sorted(CUT)
    got = {r.source: (r.documents, r.cut) for r in T.rates(df).collect()}
    assert got == {"a_b": (80 + 12, 6), None: (40, 0)}


def test_longer_copies_are_named(spark):
    docs = corpus() + [[i, t, "a_b", 0] for i, t in (CUT | FINE).items()]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, word int")
    got, texts = T.judged(df).collect(), {d[0]: d[1] for d in docs}
    named = {r.doc_id: texts[r.copy_id] for r in got if r.copy_id is not None}
    assert "The trial closed after three" in named[1001] and "pain in the " in named[1003] and "Ask your doctor about any pain" in named[1004]


def test_complete_endings_of_any_kind(spark):
    """Endings that occur nowhere but at ends of texts: known as wholes, or by prefixes that only they have."""
    docs = [*corpus(), *[[4000 + i, f"{WHOLE[i % 3]}\n\nTown{'abcdefgh'[i]} sheet {i}, on {'abcdefgh'[i]}xx palsy", "a", 0] for i in range(8)], *[[5000 + i, WHOLE[i % 3] + "\nRev. 04/2025", "a", 0] for i in range(8)]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, word int")
    assert T.judged(df).collect() == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert T.judged(df).collect() == [] and T.rates(df).collect() == []


def test_repeated_cut_texts_are_each_reported(spark):
    docs = [*corpus(), *[[3000 + i, CUT[1001], "a_b", 0] for i in range(4)]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, word int")
    assert sorted(r.doc_id for r in T.judged(df).collect()) == [3000, 3001, 3002, 3003]


def test_rows_without_an_id(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([*corpus(), [None, CUT[1001], "a", 0], [big, CUT[1001], "a", 0]], "doc_id long, text string, source string, word int")
    assert [r.doc_id for r in T.judged(df).collect()] == [big]
