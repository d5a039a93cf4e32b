"""Problem 6: evaluation passages inside training documents.

A generalised suffix automaton over the normalised words of evaluation items is built on the driver and
broadcast; every document streams its words through it, tracking the length of the longest suffix
that occurs in some item. Where that length reaches ``min_words``, the document shares a passage
with every item of the automaton state that stands for the last ``min_words`` words. Only runs of at
least ``min_words`` words that all occur in some item are streamed: no match is longer than such a run.

The evaluation set is the small side. Items come to the driver in blocks of at most ``block_words``
words (or one longer item), one automaton each, and each is streamed over the corpus in turn, so no
worker holds more than one. An automaton is sent as flat arrays: at most 2 states and 3 transitions a
word, 16 and 8 bytes each, so about 56 bytes a word and the vocabulary.

Defined results: null or empty texts, documents and items without an id, and items with fewer than ``min_words`` words, match nothing.
Repeated items all match. A document that appears twice is reported under both ids.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import stage

WORD = re.compile(r"[^\W_]+")


class _Builder:
    """The automaton while it grows: one dict of transitions per state."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        # Items only where they are read: at states of min_words words and more.
        self.owners: dict[int, set[int]] = {}
        for item, words in items:
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if n >= min_words:
                    self.owners.setdefault(last, set()).add(item)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, child: int, symbol: int) -> int:
        """The state for the words of ``state`` plus ``symbol`` alone, taken out of ``child``."""
        copy = self._new(self.length[state] + 1)
        self.next[copy], self.link[copy] = dict(self.next[child]), self.link[child]
        self.link[child] = copy
        while state >= 0 and self.next[state].get(symbol) == child:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            child = self.next[last][symbol]
            return child if self.length[child] == self.length[last] + 1 else self._split(last, child, symbol)
        new, state = self._new(self.length[last] + 1), last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state < 0:
            self.link[new] = 0
        else:
            child = self.next[state][symbol]
            self.link[new] = child if self.length[child] == self.length[state] + 1 else self._split(state, child, symbol)
        return new


class SuffixAutomaton:
    """The finished automaton as flat arrays; transitions of a state lie together, sorted by word."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int) -> None:
        built = _Builder(items, min_words)
        self.vocabulary, self.link, self.length, self.min_words = built.vocabulary, built.link, built.length, min_words
        self.first, self.symbols, self.targets = array("i", [0]), array("i"), array("i")
        for state, following in enumerate(built.next):
            for symbol in sorted(following):
                self.symbols.append(symbol)
                self.targets.append(following[symbol])
            self.first.append(len(self.symbols))
            built.next[state] = None
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        # For every state, the one that stands for its suffix of min_words words: itself, or that of its link.
        self.suffix = array("i", [0]) * len(self.length)
        for state in by_length:
            if self.length[state] >= min_words:
                self.suffix[state] = self.suffix[self.link[state]] or state
        held: dict[int, set[int]] = {}
        for state, own in built.owners.items():
            held.setdefault(self.suffix[state], set()).update(own)
        self.items = {state: tuple(sorted(own)) for state, own in held.items()}

    def _step(self, state: int, symbol: int) -> int:
        """The state after ``symbol``, or 0."""
        lo, hi = self.first[state], self.first[state + 1]
        at = bisect_left(self.symbols, symbol, lo, hi) if hi - lo > 1 else lo
        return self.targets[at] if at < hi and self.symbols[at] == symbol else 0

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """``end position, matching length, state of the last min_words words`` wherever at least ``min_words`` words match."""
        symbols, least = list(map(self.vocabulary.get, words)), self.min_words
        begin, total = 0, len(symbols)
        while begin < total:
            try:
                end = symbols.index(None, begin)
            except ValueError:
                end = total
            if end - begin >= least:
                yield from self._run(symbols, begin, end)
            begin = end + 1

    def _run(self, symbols: list[int], begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        state = size = 0
        for at in range(begin, end):
            following = self._step(state, symbols[at])
            while state and not following:
                state = self.link[state]
                size = self.length[state]
                following = self._step(state, symbols[at])
            if following:
                state = following
                size += 1
                if size >= self.min_words:
                    yield at, size, self.suffix[state]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def automata(items: DataFrame, id_col: str, text_col: str, min_words: int, block_words: int) -> list[Broadcast]:
    """Broadcast automata, each over at most ``block_words`` words (or a single longer item)."""
    context, blocks, block, held = items.sparkSession.sparkContext, [], [], 0
    for row in items.select(id_col, text_col).where(F.col(id_col).isNotNull()).toLocalIterator():
        words = words_of(row[1])
        if len(words) < min_words:
            continue
        if block and held + len(words) > block_words:
            blocks.append(context.broadcast(SuffixAutomaton(block, min_words)))
            block, held = [], 0
        block.append((row[0], words))
        held += len(words)
    return [*blocks, context.broadcast(SuffixAutomaton(block, min_words))]


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", min_words: int = 13, block_words: int = 500_000
) -> DataFrame:
    """``doc_id, item_id, longest``: each document with each item it shares at least ``min_words`` consecutive words with.

    ``longest`` is the longest run of words at whose end that item was met.
    """
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")

    def scan(automaton: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = automaton.value
            for batch in batches:
                out: list[tuple[int, int, int]] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found: dict[int, int] = {}
                    for _, size, state in a.matches(words_of(text)):
                        for item in a.items.get(state, ()):
                            found[item] = max(size, found.get(item, 0))
                    out += [(doc, item, size) for item, size in found.items()]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "longest"])

        return run

    parts = [corpus.mapInArrow(scan(a), "doc_id long, item_id long, longest int") for a in automata(items, item_id, text_col, min_words, block_words)]
    return reduce(DataFrame.unionByName, parts)


def decontaminate(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", min_words: int = 13, max_coverage: float = 0.5, block_words: int = 500_000
) -> DataFrame:
    """``doc_id, text, removed_words, coverage, dropped`` of every document that holds a leaked span.

    Spans of at least ``min_words`` matching words are cut out of the text; a document of which more
    than ``max_coverage`` of the words match is dropped whole (its text becomes null).
    """
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")

    def spans(automaton: Broadcast):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    found: list[list[int]] = []
                    for at, size, _ in automaton.value.matches(words_of(text)):
                        if found and at + 1 - size <= found[-1][1]:
                            found[-1] = [min(found[-1][0], at + 1 - size), at + 1]
                        else:
                            found.append([at + 1 - size, at + 1])
                    if found:
                        out.append((doc, text, found))
                yield pd.DataFrame(out, columns=["doc_id", "text", "spans"])

        return run

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, parts in zip(batch["doc_id"], batch["text"], batch["spans"]):
                out.append((doc, *removed(text, [tuple(x) for x in parts], max_coverage)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "removed_words", "coverage", "dropped"])

    schema = "doc_id long, text string, spans array<array<int>>"
    parts = [corpus.mapInPandas(spans(a), schema) for a in automata(items, item_id, text_col, min_words, block_words)]
    held = parts[0]
    if len(parts) > 1:  # Only documents with leaks leave a pass; those of several passes meet by id.
        held = stage(reduce(DataFrame.unionByName, parts), "p6-spans").groupBy("doc_id", "text").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return held.mapInPandas(clean, "doc_id long, text string, removed_words long, coverage double, dropped boolean")


def removed(text: str, spans: list[tuple[int, int]], max_coverage: float) -> tuple[str | None, int, float, bool]:
    """``text, removed_words, coverage, dropped`` of a text without the words of the spans."""
    low = text.lower()
    source = text if len(low) == len(text) else low
    words = list(WORD.finditer(low))
    hit = bytearray(len(words))
    for a, b in spans:
        hit[a:b] = b"\x01" * (b - a)
    kept, at = [], 0
    for i, m in enumerate(words):
        if hit[i]:
            if not (i and hit[i - 1]):
                kept.append(source[at : m.start()])
            at = m.end()
    kept.append(source[at:])
    coverage = sum(hit) / len(hit)
    dropped = coverage > max_coverage
    return None if dropped else "".join(kept), sum(hit), coverage, dropped
