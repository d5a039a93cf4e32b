"""Problem 2: cutting oversized texts at natural boundaries.

Work is by range. A worker sees one range of a text plus a halo on either side and finds the runs of
white space there, each a word, sentence or paragraph boundary. Two small tables leave the workers:

* *units*: per range the first and last boundary of each level, the longest unit between and the number
  of characters. Stitched by window functions over the ranges of a text, whose prefix-summed lengths
  give every range its offset, they yield the level of the text.
* *transfers*: a piece depends on where the one before it ended, so every range tells, for each place at
  which a piece may enter it, where the first piece beyond it begins and how many lie in it. Chains from
  different entries soon meet, so this costs little more than one cutting. Stitching follows the
  transfers from range to range and yields each range's real entry and its first piece number.

Then every range emits its own pieces by offset. The same functions cut a text of one range, whose entry
is known from the start, so pieces don't depend on the size of the ranges. Texts of a table are sliced by
the worker that holds them; files are read by byte ranges with seeks, aligned to character starts, and
no worker ever holds a whole file.

Defined results: null texts, rows without an id and texts within the limit give no pieces (``pieces_of_table``) and no
boundary. White space around the text belongs to no piece. A run of at least half a halo of white space
counts as the end of a section: a paragraph boundary that no piece reaches or overlaps across. Where no
boundary is in reach, cuts fall on multiples of ``limit - overlap``. Repeated rows are cut each.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.runtime import scratch_file, stage

LEVELS = ("character", "word", "sentence", "paragraph")
SECTION = 4
LIMIT, OVERLAP, RANGE, HALO = 1000, 120, 65_536, 4096
SPACE, NEWLINE = re.compile(r"\s+"), re.compile(r"\r\n|\n|\r")


class View(NamedTuple):
    """What a worker sees: ``text`` with the range of ``n`` characters at ``at``, which is at ``base`` of the
    whole; whether the view begins and ends with the whole."""

    text: str
    at: int
    n: int
    base: int
    first: bool
    last: bool


def views(text: str, size: int, halo: int) -> Iterator[View]:
    """The ranges of a text."""
    for base in range(0, max(1, len(text)), size):
        lo, hi = max(0, base - halo), min(len(text), base + size + halo)
        yield View(text[lo:hi], base - lo, min(size, len(text) - base), base, lo == 0, hi == len(text))


def boundaries(view: str, first: bool, last: bool, wide: int) -> tuple[list[int], list[int], list[int]]:
    """Starts, ends and levels of the runs of white space in ``view``."""
    starts, ends, levels, size = [], [], [], len(view)
    for m in SPACE.finditer(view):
        a, b = m.span()
        if (first and a == 0) or (last and b == size) or b - a >= wide:
            level = SECTION
        elif b - a > 1 and len(NEWLINE.findall(m.group())) > 1:
            level = 3
        else:
            level = 2 if a and view[a - 1] in ".!?" else 1
        starts.append(a)
        ends.append(b)
        levels.append(level)
    return starts, ends, levels


class Cutter:
    """Cuts what a view shows. Positions are those of the view; a position at which a piece begins tells the cut before it."""

    def __init__(self, view: View, limit: int, overlap: int, halo: int) -> None:
        self.view, self.limit, self.overlap, self.size = view, limit, overlap, len(view.text)
        self.starts, self.ends, self.levels = boundaries(view.text, view.first, view.last, halo // 2)
        sections = [i for i, level in enumerate(self.levels) if level == SECTION]
        self.section_starts, self.section_ends = [self.starts[i] for i in sections], [self.ends[i] for i in sections]
        self.until = view.at + view.n
        self.stop = (self.starts[-1] if self.ends and self.ends[-1] == self.size else self.size) if view.last else self.size + 1

    def begin(self) -> int:
        """Where the first piece of the whole begins, as seen from its first range."""
        return self.ends[0] if self.starts and self.starts[0] == 0 else 0

    def end_before(self, pos: int) -> int | None:
        """Where the piece before the one at ``pos`` ends, unless nothing is shared with it."""
        if pos == 0 and self.view.first:
            return None
        i = bisect_left(self.ends, pos)
        if i < len(self.ends) and self.ends[i] == pos:
            return None if self.levels[i] == SECTION else self.starts[i]
        return pos

    def piece(self, pos: int) -> tuple[int, int, int, int]:
        """``start, stop, level of the cut, next position`` of the piece that continues at ``pos``.

        It ends with its section if that is in reach, or else at the coarsest boundary within reach, the
        farthest of that level that leaves room for the whole overlap, or else the farthest. It starts at
        most ``overlap`` characters before the end of the piece before, as far back as the limit allows, at
        a boundary if there is one.
        """
        starts, ends, limit, before = self.starts, self.ends, self.limit, self.end_before(pos)
        i = bisect_right(self.section_starts, pos)
        end, after = (self.section_starts[i], self.section_ends[i]) if i < len(self.section_starts) else (self.size, self.size) if self.view.last else (pos + limit + 1, 0)
        if end - pos <= limit:
            stop, level = end, 3
        else:
            low, high = bisect_right(starts, pos), bisect_right(starts, pos + limit)
            near = high if before is None else bisect_right(starts, before - self.overlap + limit)
            level = max(self.levels[low:high], default=0)
            if level:
                fitting = [k for k in range(low, high) if self.levels[k] == level]
                best = next((k for k in reversed(fitting) if k < near), fitting[-1])
                stop, after = starts[best], ends[best]
            else:
                grid, shift = limit - self.overlap, self.view.base - self.view.at
                stop = after = ((pos + shift) // grid + 1) * grid - shift
        start = pos
        if before is not None:
            floor = max(before - self.overlap, stop - limit)
            k = bisect_left(ends, floor)
            if k < len(ends) and ends[k] < before:
                start = ends[k]
            elif floor < before:
                start = floor
        return start, stop, level, after

    def pieces(self, pos: int) -> Iterator[tuple[int, int, int]]:
        """``start, stop, level`` of the pieces that continue within the range, from the one at ``pos`` on."""
        while pos < self.until and pos < self.stop:
            start, stop, level, pos = self.piece(pos)
            yield start, stop, level

    def entries(self) -> list[tuple[int, int]]:
        """The cuts after which a piece may be the first within the range, as start and end of their white space."""
        at, reach = self.view.at, self.view.at + self.limit
        found = [(self.starts[i], self.ends[i]) for i in range(bisect_left(self.ends, at), bisect_left(self.starts, reach))]
        grid, shift = self.limit - self.overlap, self.view.base - self.view.at
        for x in range(-(-(at + shift) // grid) * grid - shift, reach, grid):
            i = bisect_left(self.starts, x)
            free = i == len(self.starts) or self.starts[i] > x + self.overlap
            if free and not (i and self.ends[i - 1] > x):
                found.append((x, x))
        return sorted(found, key=lambda e: (e[1], e[0]))

    def transfers(self) -> list[tuple[int, int, int, int]]:
        """``start, end`` of every entry (the text's begin in its first range), the position after the range, and the number of pieces."""
        known: dict[int, tuple[int, int]] = {}
        entries = [(-1, self.begin())] if self.view.base == 0 else self.entries()
        for _, pos in entries:
            path = []
            while pos not in known and pos < self.until and pos < self.stop:
                path.append(pos)
                pos = self.piece(pos)[3]
            leaves, n = known.get(pos, (pos, 0))
            for x in reversed(path):
                n += 1
                known[x] = leaves, n
            known.setdefault(pos, (leaves, 0))
        shift = self.view.base - self.view.at
        return [(a + shift, b + shift, known[b][0] + shift, known[b][1]) for a, b in entries]


def _checked(limit: int, overlap: int, size: int, halo: int) -> None:
    if not 0 <= overlap < limit or halo < 2 * limit or size < 1:
        raise ValueError("the overlap must be below the limit, and the halo at least twice the limit")


# --- levels --------------------------------------------------------------------------------------

UNITS = "id {id}, key long, part int, n long, " + ", ".join(f"{x}{k} long" for k in (1, 2, 3) for x in ("start", "last", "inner"))


def units(view: View, halo: int) -> list[int | None]:
    """Of each level: the start of the first and the end of the last boundary that touches the range, and the longest unit between."""
    found = [x for x in zip(*boundaries(view.text, view.first, view.last, halo // 2)) if x[1] > view.at and x[0] < view.at + view.n]
    row: list[int | None] = []
    for k in (1, 2, 3):
        own = [(a - view.at, b - view.at) for a, b, level in found if level >= k]
        row += [own[0][0] if own else None, own[-1][1] if own else None, max((b[0] - a[1] for a, b in zip(own, own[1:])), default=0)]
    return row


def _stitched_levels(parts: DataFrame, limit: int) -> DataFrame:
    """``id, level`` from the units of all ranges."""
    whole, order = W.partitionBy("id", "key"), W.partitionBy("id", "key").orderBy("part")
    past = order.rowsBetween(W.unboundedPreceding, -1)
    t = parts.withColumns({"base": F.coalesce(F.sum("n").over(past), F.lit(0)), "size": F.sum("n").over(whole)})
    before = {f"before{k}": F.coalesce(F.max(F.col(f"last{k}") + F.col("base")).over(past), F.lit(0)) for k in (1, 2, 3)}
    t = t.withColumns(before)
    longest = [F.max(F.greatest(f"inner{k}", F.col(f"start{k}") + F.col("base") - F.col(f"before{k}"))).alias(f"gap{k}") for k in (1, 2, 3)]
    ends = [F.coalesce(F.max(F.col(f"last{k}") + F.col("base")), F.lit(0)).alias(f"end{k}") for k in (1, 2, 3)]
    u = t.groupBy("id", "key").agg(F.first("size").alias("size"), *longest, *ends)
    fits = lambda k: F.greatest(f"gap{k}", F.col("size") - F.col(f"end{k}")) <= limit
    return u.select("id", F.when(fits(3), 3).when(fits(2), 2).when(fits(1), 1).otherwise(0).alias("level"))


def boundary_levels(df: DataFrame, id_col: str = "row_id", text_col: str = "verbatim_text", limit: int = LIMIT, range_chars: int = RANGE, halo: int = HALO) -> DataFrame:
    """``row_id, boundary``: for every text over the limit, the coarsest level at which all units are within it."""
    _checked(limit, 0, range_chars, halo)
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where((F.length("text") > limit) & F.col("id").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in UNITS.split(", ")]
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"]):
                key = random.getrandbits(63)  # tells repeated ids apart; the table is written once
                out += [(i, key, part, v.n, *units(v, halo)) for part, v in enumerate(views(text, range_chars, halo))]
            yield pd.DataFrame(out, columns=names).astype({x: "Int64" for x in names[3:]})

    parts = stage(base.mapInPandas(run, UNITS.format(id=dict(base.dtypes)["id"])), "p2-units")
    names = F.array(*[F.lit(x) for x in LEVELS])
    return _stitched_levels(parts, limit).select(F.col("id").alias("row_id"), F.element_at(names, F.col("level") + 1).alias("boundary"))


# --- pieces --------------------------------------------------------------------------------------

TRANSFERS = "id {id}, key long, part int, base long, n long, enter array<long>, begin array<long>, leave array<long>, pieces array<long>"
STATES = "id {id}, key long, part int, begin long, piece long"
PIECES = "id {id}, piece long, start long, stop long, boundary string, text string"
#: The view of a range and what names it.
Ranges = Callable[[pd.DataFrame], Iterator[tuple[tuple, View]]]


def _transfers(ranges: Ranges, limit: int, overlap: int, halo: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (i, key, part), view in ranges(batch):
                columns = [list(c) for c in zip(*Cutter(view, limit, overlap, halo).transfers())] or [[], [], [], []]
                out.append((i, key, part, view.base, view.n, *columns))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in TRANSFERS.split(", ")])

    return run


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the pieces of every range begin, for the transfers of texts in order; ranges that no piece continues in drop out."""
    text, at, done = None, 0, 0
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.id, r.key) != text:
                text, at, done = (r.id, r.key), None, 0
            if at is None:
                k = 0
            elif at >= r.base + r.n:
                continue
            else:
                k = bisect_left(r.begin, at)
                if k == len(r.begin) or not (r.enter[k] < at or r.enter[k] == at == r.begin[k]):
                    raise RuntimeError(f"no entry at {at} of {r.id}")
            if r.pieces[k]:
                out.append((r.id, r.key, r.part, int(r.begin[k]), done))
            at, done = int(r.leave[k]), done + int(r.pieces[k])
        yield pd.DataFrame(out, columns=["id", "key", "part", "begin", "piece"])


def _states(transfers: DataFrame) -> DataFrame:
    """The transfers of a text pass through one task in order, as a stream of small rows."""
    kind = dict(transfers.dtypes)["id"]
    return transfers.repartition("id", "key").sortWithinPartitions("id", "key", "part").mapInPandas(_follow, STATES.format(id=kind))


def _emitted(cutter: Cutter, begin: int, piece: int) -> Iterator[tuple]:
    shift = cutter.view.base - cutter.view.at
    for k, (a, b, level) in enumerate(cutter.pieces(begin - shift if begin >= 0 else cutter.begin())):
        yield piece + k, a + shift, b + shift, LEVELS[level], cutter.view.text[a:b]


def pieces_of_table(
    df: DataFrame, id_col: str = "row_id", text_col: str = "verbatim_text", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE, halo: int = HALO
) -> DataFrame:
    """``row_id, piece, start, stop, boundary, text`` of every text over the limit; offsets count characters."""
    _checked(limit, overlap, range_chars, halo)
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where((F.length("text") > limit) & F.col("id").isNotNull()).withColumn("key", F.xxhash64("text"))
    kind = dict(base.dtypes)["id"]
    one, many = base.where(F.length("text") <= range_chars), base.where(F.length("text") > range_chars)

    def ranges(batch: pd.DataFrame) -> Iterator[tuple[tuple, View]]:
        for r in batch.itertuples(index=False):
            yield from (((r.id, r.key, part), v) for part, v in enumerate(views(r.text, range_chars, halo)))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                states = {s["part"]: s for s in r.states}
                for part, view in enumerate(views(r.text, range_chars, halo)):
                    if part in states:
                        out = [(r.id, *x) for x in _emitted(Cutter(view, limit, overlap, halo), states[part]["begin"], states[part]["piece"])]
                        yield pd.DataFrame(out, columns=["id", "piece", "start", "stop", "boundary", "text"])

    def emit_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [((r.id, *x)) for r in batch.itertuples(index=False) for view in views(r.text, range_chars, halo) for x in _emitted(Cutter(view, limit, overlap, halo), -1, 0)]
            yield pd.DataFrame(out, columns=["id", "piece", "start", "stop", "boundary", "text"])

    transfers = stage(many.mapInPandas(_transfers(ranges, limit, overlap, halo), TRANSFERS.format(id=kind)).dropDuplicates(["id", "key", "part"]), "p2-transfers")
    #: A cell holds at most 2 GB, so its states are a short list.
    states = _states(transfers).groupBy("id", "key").agg(F.collect_list(F.struct("part", "begin", "piece")).alias("states"))
    long = many.join(states, ["id", "key"]).mapInPandas(emit, PIECES.format(id=kind))
    return one.mapInPandas(emit_short, PIECES.format(id=kind)).unionByName(long).withColumnRenamed("id", "row_id")


def _aligned(data: bytes, at: int) -> int:
    """The first start of a character from ``at`` on."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _file_ranges(range_bytes: int, halo: int) -> Ranges:
    """Byte ranges of files, read with seeks; a character belongs to the range that holds its first byte."""

    def read(batch: pd.DataFrame) -> Iterator[tuple[tuple, View]]:
        from pyarrow import fs

        for r in batch.itertuples(index=False):
            source, name = fs.FileSystem.from_uri(r.id)
            lo = r.part * range_bytes
            first, last = max(0, lo - 4 * halo - 4), min(r.length, lo + range_bytes + 4 * halo + 4)
            with source.open_input_file(name) as f:
                f.seek(first)
                data = f.read(last - first)
            a, b = _aligned(data, lo - first), _aligned(data, min(lo + range_bytes, r.length) - first)
            head = data[_aligned(data, 0) if first else 0 : a].decode("utf-8", "replace")
            own = data[a:b].decode("utf-8", "replace")
            tail = data[b:].decode("utf-8", "ignore" if last < r.length else "replace")
            at_start, at_end = first == 0 and len(head) <= halo, last == r.length and len(tail) <= halo
            head, tail = head[-halo:], tail[:halo]
            yield (r.id, 0, r.part), View(head + own + tail, len(head), len(own), r.base, at_start, at_end)

    return read


def pieces_of_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 8 << 20, halo: int = HALO) -> DataFrame:
    """``path, piece, start, stop, boundary, text`` of UTF-8 files of any size; files within the limit are one piece.

    Ranges are read three times: for their lengths in characters, for their transfers, and for their pieces.
    """
    _checked(limit, overlap, range_bytes, halo)
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), F.col("length")).where("length > 0")
    parts = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / F.lit(range_bytes)).cast("int") - 1)))
    read = _file_ranges(range_bytes, halo)

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*name[::2], n, view.n) for n, (name, view) in zip(batch["length"], read(batch.assign(base=0)))]
            yield pd.DataFrame(out, columns=["id", "part", "length", "n"])

    counted = stage(parts.repartition("id", "part").mapInPandas(lengths, "id string, part int, length long, n long"), "p2-lengths")
    before = W.partitionBy("id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = stage(counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "p2-ranges")
    spread = ranges.repartition("id", "part")
    transfers = stage(spread.mapInPandas(_transfers(read, limit, overlap, halo), TRANSFERS.format(id="string")), "p2-transfers")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for state, (name, view) in zip(batch.itertuples(index=False), read(batch)):
                out = [(name[0], *x) for x in _emitted(Cutter(view, limit, overlap, halo), state.begin, state.piece)]
                yield pd.DataFrame(out, columns=["id", "piece", "start", "stop", "boundary", "text"])

    states = spread.join(_states(transfers).drop("key"), ["id", "part"])
    return states.mapInPandas(emit, PIECES.format(id="string")).withColumnRenamed("id", "path")


def files_of_table(df: DataFrame, text_col: str = "verbatim_text") -> str:
    """Writes the texts of a table, separated by blank lines, as files to the shared folder; returns the folder."""
    path = scratch_file(df.sparkSession, "p2-files")
    df.where(F.col(text_col).isNotNull()).select(text_col).write.option("lineSep", "\n\n").text(path)
    return path
