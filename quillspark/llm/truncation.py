"""Problem 8: texts that were cut off.

A cut text ends in a fragment, and the fragment is a strict prefix of longer copies elsewhere: not of
whole texts (a cut text and its source rarely both survive) but of the same sentence, list item, table
row or line as other texts hold it. So the last segment of every text that does not end with a full
stop is joined, by hashes of fixed-length prefixes, with the segments of the whole corpus. Segments are
compared as templates, in which numbers are ``#`` and words that few texts use are ``~``. What decides:

1. ``word``: the last word occurs nowhere else and is a strict prefix of a longer word;
2. a text whose whole last segment is found elsewhere as a whole is not cut, unless nearly all copies go on or its last word
   is a strict prefix of one that follows the same word elsewhere;
3. ``sentence``: copies of the longest prefix (without the last word) that enough others share end with a full stop, so an
   open copy is cut;
4. ``goes on``: of the open lines that begin like the whole segment, or of the items and rows that hold its last two tokens
   (or its last), nearly all go on there;
5. ``word``: the last word was never met behind the one before it, but a longer one was.

``copy_id`` is a text that holds the longer copy (null for a marker alone, and for a longer word that is common). A marker of a cut (dots, an ellipsis, a replacement
character, a broken tag) is part of the ending: only copies that end with one too speak against a cut.

Defined results: null texts, texts without letters or digits and rows without an id are not cut. White space and closing
mark-up after the end are ignored. Repeated texts are each reported. Nothing is sampled and no text or
segment is shortened; the common words (used by at least one in a hundred texts) are the only corpus
statistic that reaches the driver, at most a hundred times the mean number of distinct words. A text
of whose ending the corpus holds no copy at all is cut only if it has a marker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from xxhash import xxh3_64_intdigest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import attach_groups, stage

#: Mark-up at the end, whole or broken.
TAG, BROKEN = re.compile(r"</?[A-Za-z][^<>]*>"), re.compile(r"</?(?:[A-Za-z][A-Za-z0-9]*(?:\s+[\w-]+\s*=[^<>]*)?)?$")
CLOSED = re.compile(r"[.!?][\")\]»”’'*_]*$")
CLOSE_INSIDE = re.compile(r"[.!?][\")\]»”’']*\s+(?=\S)")
ITEM = re.compile(r"^\s*(?:[*•‣▪◦–-]|\d+[.)])\s+")
TOKEN = re.compile(r"\d(?:[\d.,/]*\d)?|[^\W\d_]+|[^\w\s]")
COMMON_SHARE = 0.01
#: Prefix lengths in tokens; longer ones follow by doubling.
LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Other texts that must share a prefix or a whole line for it to decide, segments that must share the last tokens, and the
#: share of copies up to which an ending counts as none.
COPIES, ENOUGH, ENDS = 3, 5, 0.1
#: A list of ids of up to this length is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: What a key stands for.
START, WHOLE, OPEN, PAIR, TAIL, WORD, NEXT = range(7)


def core_of(text: str) -> tuple[str, bool]:
    """The text without what may follow a cut, and whether a marker of a cut was among that."""
    marked = False
    while True:
        text = text.rstrip()
        last, at = text[-1:], None
        if last == ">":
            tag = text.rfind("<")
            if tag < 0 or not TAG.match(text, tag):
                return text, marked
            text = text[:tag]
            continue
        if last == "." and text.endswith(".."):
            at = len(text.rstrip("."))
        elif last and last in "…\ufffd":
            at = len(text) - 1
        elif last and last in ")]":
            inner = text[:-1].rstrip(".…")
            dots = text[len(inner) : -1]
            if inner[-1:] in ("[", "(") and ("…" in dots or len(dots) > 1):
                at = len(inner) - 1
        else:
            tag = text.rfind("<")
            if tag >= 0 and BROKEN.match(text, tag):
                at = tag
        if at is None:
            return text, marked
        text, marked = text[:at], True


def templated(words: list[str], common: set[str]) -> list[str]:
    return [w if w in common else "~" if w[0].isalpha() else w if not w[0].isdigit() else "####" if len(w) == 4 and w.isdigit() else "#" for w in words]


def kind_of(line: str) -> str:
    return "row" if line.startswith("|") else "item" if ITEM.match(line) else "line"


def parts_of(line: str) -> tuple[str, list[str]]:
    """The kind of a line and its segments: the sentences of a plain line, an item or row as a whole."""
    kind = kind_of(line)
    return kind, CLOSE_INSIDE.split(line) if kind == "line" else [ITEM.sub("", line) if kind == "item" else line]


def lengths(n: int) -> Iterator[int]:
    at = LENGTHS[-1]
    yield from (k for k in LENGTHS if k <= n)
    while (at := at * 2) <= n:
        yield at


def hashed(what: int, kind: str, template: list[str]) -> int:
    h = xxh3_64_intdigest(f"{what} {kind} {' '.join(template)}")
    return h - (1 << 64) if h >> 63 else h


ENDINGS = "doc_id long, kind string, marked boolean, word string, rare boolean, before string, tokens int, deepest int, keys array<struct<what: int, level: int, h: long>>"


def _endings(common: set[str]):
    """One row for every text that does not end with a full stop, with the keys that its ending is looked up by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ENDINGS.split(", ")[:8]] + ["keys"]
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                core, marked = core_of(text or "")
                if not re.search(r"\w", core) or CLOSED.search(core):
                    continue
                kind, parts = parts_of(core[core.rfind("\n") + 1 :].strip())
                words = TOKEN.findall(parts[-1].lower())
                if not words:
                    continue
                t = templated(words, common)
                before = f"{kind} {t[-2] if len(t) > 1 else '^'}"
                keys = [(PAIR, 2, hashed(PAIR, before, t[-1:]))]
                if kind == "line":
                    keys += [(k, len(t), hashed(k, kind, t)) for k in (WHOLE, OPEN)]
                    keys += [(START, n, hashed(START, kind, t[:n])) for n in lengths(len(t))]
                else:
                    keys.append((TAIL, 1, hashed(TAIL, kind, t[-1:])))
                out.append((doc, kind, marked, words[-1], t[-1] == "~", before, len(t), max(lengths(len(t))), keys))
            yield pd.DataFrame(out, columns=names)

    return run


STATISTICS = "what int, h long, w string, a long, b long, m long, copy long"


def _statistics(common: set[str]):
    """What the segments of the distinct texts say, summed per batch: how many copies went on (``a``), ended (``b``) and ended with
    a marker (``m``), and a text in which one went on. For ``START`` (prefixes of lines) going on means up to a full
    stop. Of segments without one, ``WHOLE`` holds whole lines, ``OPEN`` all their shorter prefixes, ``PAIR`` two tokens and ``TAIL``
    one (of items and rows). ``WORD`` (rare words) and ``NEXT`` (common words with the token before) are only noted. The last segment of a text may be cut itself, so it counts for lines only,
    which have endings that occur nowhere else (sources, sign-offs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefixes = [tuple(lengths(n)) for n in range(256)]
        for batch in batches:
            # Per kind of key: how many went on, ended, ended with a marker; and a text in which one went on.
            on, over, cut, copy = ([{} for _ in range(NEXT + 1)] for _ in range(4))
            start, start_copy, words_of, next_of = on[START], copy[START], copy[WORD], copy[NEXT]
            for doc, text in zip(batch["doc_id"], batch["text"]):
                core, marked = core_of(text or "")
                lines = core.split("\n")
                for at, line in enumerate(lines):
                    line = line.strip()
                    if not line:
                        continue
                    final = at == len(lines) - 1
                    kind, parts = parts_of(line)
                    for n, part in enumerate(parts):
                        words = TOKEN.findall(part.lower())
                        if not words:
                            continue
                        last = final and n == len(parts) - 1
                        closed = n < len(parts) - 1 or CLOSED.search(part) is not None
                        t, size = templated(words, common), len(words)
                        ended = cut if last and marked else over
                        if kind == "line":
                            counted = start if closed else ended[START]
                            for k in prefixes[size] if size < 256 else lengths(size):
                                key = " ".join(t[:k])
                                counted[key] = counted.get(key, 0) + 1
                                if closed:
                                    start_copy[key] = doc
                            if not closed:
                                key = " ".join(t)
                                ended[WHOLE][key] = ended[WHOLE].get(key, 0) + 1
                                for k in range(1, size):
                                    key = " ".join(t[:k])
                                    on[OPEN][key] = on[OPEN].get(key, 0) + 1
                                    copy[OPEN][key] = doc
                        elif last and not closed:
                            # A row or item that may be cut itself; its whole words are words all the same.
                            for x, w in zip(t[:-1], words):
                                if x == "~":
                                    words_of[w] = doc
                            continue
                        before = "^"
                        for x, w in zip(t[:-1] if last else t, words):
                            if x == "~":
                                words_of[w] = doc
                            elif x[0].isalpha():
                                next_of[f"{kind} {before} {x}"] = doc
                            before = x
                        if closed:
                            continue
                        before = "^"
                        for i, x in enumerate(t):
                            for what, key in ((PAIR, f"{kind} {before} {x}"), (TAIL, f"{kind} {x}"))[: 1 if kind == "line" else 2]:
                                held = ended[what] if i == size - 1 else on[what]
                                held[key] = held.get(key, 0) + 1
                                if i < size - 1:
                                    copy[what][key] = doc
                            before = x
            yield from _counted(on, over, cut, copy)

    return run


def _counted(on: list[dict], over: list[dict], cut: list[dict], copy: list[dict]) -> Iterator[pd.DataFrame]:
    """The counts of a batch as rows; words keep their text, all other keys their hash."""
    for what in range(NEXT + 1):
        keys = list(on[what].keys() | over[what].keys() | cut[what].keys() | copy[what].keys())
        if not keys:
            continue
        middle = " line " if what < PAIR else " "
        h = [xxh3_64_intdigest(f"{what}{middle}{k}") for k in keys]
        frame = pd.DataFrame({"what": what, "h": [x - (1 << 64) if x >> 63 else x for x in h], "w": keys if what >= WORD else [None] * len(keys)})
        for name, c in zip("abm", (on, over, cut)):
            frame[name] = [c[what].get(k, 0) for k in keys]
        frame["copy"] = pd.array([copy[what].get(k) for k in keys], "Int64")
        yield frame


def common_words(docs: DataFrame) -> set[str]:
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)))
    used = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    least = max(2, int(docs.count() * COMMON_SHARE))
    return {r.w for r in used.where(F.col("n") >= least).select("w").toLocalIterator()}


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row per text: the ids of repeated texts are found by hash, so that the texts themselves stay where they are."""
    ids = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    first = ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    repeated = stage(ids.select("doc_id").join(first.select("doc_id"), "doc_id", "left_anti"), "p8-repeated")
    return docs.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated, "doc_id", "left_anti")


def _strict_prefixes(key: Column) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda n: F.substring(key, F.lit(1), n)))


def _longer(stats: DataFrame, stubs: DataFrame) -> DataFrame:
    """``w, copy_id``: of the distinct ``stubs``, those that are strict prefixes of a corpus word."""
    words = stats.where("length(w) > 1").select(_strict_prefixes(F.col("w")).alias("w"), "copy")
    return words.join(stubs, "w", "left_semi").groupBy("w").agg(F.max("copy").alias("copy_id"))


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, why, copy_id`` of every cut text."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    common = docs.sparkSession.sparkContext.broadcast(common_words(docs)).value
    ends = stage(docs.mapInPandas(_endings(common), ENDINGS), "p8-endings")
    counts = distinct_texts(docs).mapInPandas(_statistics(common), STATISTICS)
    stats = stage(counts.groupBy("what", "h", "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("m").alias("m"), F.max("copy").alias("copy")), "p8-statistics")

    keys = ends.select("doc_id", "kind", "marked", "tokens", "deepest", F.explode("keys").alias("k")).select("doc_id", "kind", "marked", "tokens", "deepest", "k.*")
    asked_for = keys.groupBy("h").agg(F.count("*").alias("n"))
    known = stats.where(F.col("what") < WORD).select("h", "a", "b", "m", "copy").join(asked_for, "h")
    found = attach_groups(keys, known, ["h"], "n", keys.count())
    # A line's own ending is among the counts, those of items and rows are not.
    own = F.when(F.col("kind") == "line", 1).otherwise(0)
    found = found.withColumn("ended", F.when(F.col("marked"), F.col("m")).otherwise(F.col("b")) - own).withColumn("seen", F.col("a") + F.col("b") + F.col("m") - own)
    of = lambda what, cond, *cols: F.max(F.when((F.col("what") == what) & cond, F.struct(*cols)))
    # The last word may be a part of one, which only cut texts have: it says nothing about the kind of line.
    inner = (F.col("level") < F.col("tokens")) | (F.col("level") == 1)
    yes, enough = F.lit(True), F.col("seen") >= COPIES
    evidence = found.groupBy("doc_id").agg(
        of(WHOLE, yes, "ended").alias("whole"), of(OPEN, yes, "a", "copy").alias("open"), of(PAIR, yes, "seen", "ended", "copy").alias("pair"), of(TAIL, yes, "seen", "ended", "copy").alias("tail"),
        of(START, enough & inner, "level", "a", "seen", "copy").alias("start"), of(START, inner & (F.col("seen") > 0), "level", "a", "seen", "copy").alias("rare_start"), of(START, F.col("level") == F.col("deepest"), "seen").alias("deep"),
    )
    asked = ends.drop("keys", "tokens", "deepest").join(evidence, "doc_id", "left")
    words = stats.where(F.col("what") == WORD).select(F.col("w").alias("word"), F.lit(True).alias("word_seen"))
    asked = asked.join(words, "word", "left").withColumn("pair_seen", F.coalesce("pair.seen", F.lit(0)))
    unknown = asked.where("rare and word_seen is null").select(F.col("word").alias("w")).distinct()
    common_rows = docs.sparkSession.createDataFrame([(w, None) for w in sorted(common)], "w string, copy long")
    longer = _longer(stats.where(F.col("what") == WORD).select("w", "copy").unionByName(common_rows), unknown).select(F.col("w").alias("word"), F.col("copy_id").alias("longer_id"), F.lit(True).alias("longer"))
    stub = F.concat_ws(" ", "before", "word")
    grows = _longer(stats.where(F.col("what") == NEXT), asked.where("kind = 'line' or pair_seen <= 0").select(stub.alias("w")).distinct())
    asked = asked.join(longer, "word", "left").withColumn("stub", stub).join(grows.select(F.col("w").alias("stub"), F.col("copy_id").alias("grows_id")), "stub", "left")

    start = F.coalesce("start", "rare_start")
    is_line, nearly_none = F.col("kind") == "line", lambda x: F.col(f"{x}.ended") < ENDS * F.col(f"{x}.seen")
    whole = is_line & F.col("grows_id").isNull() & (F.col("whole.ended") >= COPIES) & (F.col("whole.ended") >= ENDS * F.coalesce("deep.seen", F.lit(0)))
    decided = lambda why, copy: F.struct(F.lit(why).alias("why"), copy.cast("long").alias("copy_id"))
    verdict = (
        F.when(F.col("rare") & F.col("word_seen").isNull() & F.col("longer"), decided("word", F.col("longer_id")))
        .when(whole, None)
        .when(is_line & (start["a"] > start["seen"] - start["a"]), decided("sentence", start["copy"]))
        .when(is_line & (F.col("open.a") >= ENOUGH) & (F.coalesce("whole.ended", F.lit(0)) < ENDS * F.col("open.a")), decided("goes on", F.col("open.copy")))
        .when(~is_line & enough_of("pair") & nearly_none("pair"), decided("goes on", F.col("pair.copy")))
        .when(~enough_of("pair") & enough_of("tail") & nearly_none("tail"), decided("goes on", F.col("tail.copy")))
        .when((F.col("pair_seen") <= 0) & F.col("grows_id").isNotNull(), decided("word", F.col("grows_id")))
        .when(F.col("marked") & ~enough_of("pair") & ~enough_of("tail"), decided("marker", F.lit(None)))
    )
    return asked.select("doc_id", verdict.alias("v")).where("v is not null").select("doc_id", "v.*")


def enough_of(what: str) -> Column:
    return F.coalesce(F.col(f"{what}.seen"), F.lit(0)) >= ENOUGH


def source_name(source: Column) -> Column:
    """One spelling per source: lower case, trimmed, ``_`` for ``-``."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s ]+|[\s ]+$", "")), "-", "_")


def rates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``source, documents, cut, share``: how often each source truncates; a null source is its own row."""
    cut = judged(df, id_col, text_col).select(F.col("doc_id").alias("cut_id")).distinct()
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), source_name(F.col(source_col)).alias("source"))
    marked = base.join(cut, base.doc_id == cut.cut_id, "left")
    return marked.groupBy("source").agg(F.count("*").alias("documents"), F.count("cut_id").alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))
