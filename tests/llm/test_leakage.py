import random
import re

from quillspark.llm import leakage as L


def grams(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string, exam string")


def test_against_brute_force(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(r.choices(words, k=r.randint(0, 30))), "e") for i in range(30)] + [(90, None, "e"), (91, "", "e")]
    items.append((92, items[3][1], "e"))
    docs = []
    for i in range(200):
        w = r.choices(words, k=r.randint(0, 40))
        if r.random() < 0.6:
            src = r.choice(items)[1] or ""
            a = r.randint(0, 10)
            w[5:5] = src.split()[a : a + r.randint(1, 20)]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w).title(), 0))
    docs += [(900, None, 0), (901, "", 0), docs[5]]
    d, e = tables(spark, docs, items)
    truth = sorted((i, j) for i, t, _ in docs for j, u, _ in items if grams(t, 5) & grams(u, 5))
    for block_words in (2_000_000, 40):
        got = sorted((x.doc_id, x.item_id) for x in L.leaks(d, e, min_words=5, block_words=block_words).collect())
        assert got == truth


def test_longest_run_and_removal(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    d, e = tables(spark, [(1, f"Before, {passage.upper()}! After it a tail of more words than the passage has, " + "x " * 20, 0), (2, passage, 0), (3, "clean", 0)], [(7, f"head {passage} tail", "e")])
    assert {(r.doc_id, r.longest) for r in L.leaks(d, e).collect()} == {(1, 15), (2, 15)}
    got = {r.doc_id: r for r in L.decontaminate(d, e).collect()}
    assert set(got) == {1, 2} and got[2].dropped and got[2].text is None
    assert "P3" not in got[1].text and got[1].text.startswith("Before, ") and "After it" in got[1].text and got[1].removed_words == 15


def test_removal_with_several_automata(spark):
    """Spans of several blocks of items are cut out together, as with one block."""
    a, b = (" ".join(f"{x}{i}" for i in range(14)) for x in "pq")
    docs = [(1, f"one {a} two {b} three " + "y " * 60, 0), (2, f"{b} " + "z " * 40, 0), (3, "nothing here", 0), (1, f"one {a} two {b} three " + "y " * 60, 0)]
    d, e = tables(spark, docs[:3], [(7, a, "e"), (8, b, "e")])
    one, two = (sorted(map(tuple, L.decontaminate(d, e, block_words=n).collect())) for n in (10_000, 14))
    assert one == two and [x[2] for x in one] == [28, 14] and one[0][1].split()[:3] == ["one", "two", "three"]


def test_size_of_an_automaton():
    """Flat arrays: a bounded number of bytes for every word of the items."""
    r = random.Random(2)
    items = [(i, [f"w{r.randrange(3000)}" for _ in range(200)]) for i in range(100)]
    a = L.SuffixAutomaton(items, 13)
    held = sum(x.itemsize * len(x) for x in (a.first, a.symbols, a.targets, a.link, a.length, a.suffix))
    assert held <= 56 * 20_000


def test_empty_tables(spark):
    d, e = tables(spark, [], [])
    assert L.leaks(d, e).collect() == [] and L.decontaminate(d, e).collect() == []


def test_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    d, e = tables(spark, [(1, "filler " * 500_000 + passage, 0)], [(7, passage, "e")])
    assert [(r.doc_id, r.item_id) for r in L.leaks(d, e).collect()] == [(1, 7)]


def test_rows_without_an_id(spark):
    passage, big = " ".join(f"p{i}" for i in range(13)), 2**60 + 1
    d, e = tables(spark, [(None, passage, 0), (big, passage, 0)], [(7, passage, "e"), (None, passage, "e")])
    assert [(r.doc_id, r.item_id) for r in L.leaks(d, e).collect()] == [(big, 7)]
    assert [r.doc_id for r in L.decontaminate(d, e).collect()] == [big]
