"""Problem 3: lines repeated across one source's documents.

A line is its letters in lower case; digits, punctuation and spaces mean nothing. Its tokens are blocks of
letters, one more than letters may differ, so that one block at least is whole; the other blocks are wildcard
slots. Each task counts the lines of its rows; the counts are merged by key, and spellings that are frequent
enough to be the core of a repeated line go into the token tree of their source: length class and place of a
block, the block's letters, a block of the rest, templates. The tree is a table keyed by node, so the trees of
all partitions are merged by key, a large source is as many nodes, and nothing of it is collected. In a node,
by falling count, a core joins the template that it is the same as or becomes one; a source has few cores, as
each stands for a share of its chunks. Lines then meet the templates of their nodes, once a spelling, and support is counted over distinct chunks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, stage
from .bitmap import Bitmap, hash_of

_NOT_LETTER = re.compile(r"[\W\d_]+")
#: Lengths of one class share the size of their blocks.
CLASS = 8
#: A task sends its counts on when it holds so many lines.
HELD_LINES = 200_000
#: Rows that a task remembers, to pass over repeats.
HELD_ROWS = 1_000_000
BITMAP_BLOCKS = 1 << 20
#: A letter that stands for a line's end while a text's letters are taken.
_END = "\U00010380"


def letters(line: str) -> str:
    """The letters of a line, lower case."""
    return _NOT_LETTER.sub("", line.lower())


def text_letters(text: str) -> list[str]:
    """The letters of each line."""
    if _END in text:
        return [letters(x) for x in text.split("\n")]
    return _NOT_LETTER.sub("", text.lower().replace("\n", _END)).split(_END)


def within(a: str, b: str, k: int) -> bool:
    """Is the edit distance at most k?"""
    if abs(len(a) - len(b)) > k:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    if i == n and len(a) == len(b):
        return True
    if k == 0:
        return False
    a, b = a[i:], b[i:]
    return within(a[1:], b[1:], k - 1) if len(a) == len(b) and k == 1 else (
        within(a[1:], b[1:], k - 1) or within(a[1:], b, k - 1) or within(a, b[1:], k - 1)
    )


class Shape:
    """Where the blocks of a line stand: ``edits`` + 1 of them, of a size that its length class gives."""

    def __init__(self, fuzzy_from: int, edits: int):
        self.fuzzy_from, self.edits = fuzzy_from, edits
        self.least = fuzzy_from - edits  # shorter lines are compared exactly
        self.places: dict[int, list[tuple[str, int, int]]] = {}

    def allowed(self, n: int) -> int:
        """How many of n letters may differ: two from ``fuzzy_from`` on, more in longer lines."""
        return 0 if n < self.fuzzy_from else min(self.edits, 2 * n // self.fuzzy_from)

    def low(self, cls: int) -> int:
        """The least length in a class."""
        return max(CLASS * cls, self.least)

    def block(self, cls: int) -> int:
        return self.low(cls) // (self.edits + 1)

    def rest_block(self, cls: int) -> int:
        return max(1, (self.low(cls) - self.block(cls)) // (self.edits + 1))

    def starts(self, n: int, size: int) -> list[int]:
        return [j * (n - size) // self.edits for j in range(self.edits + 1)]

    def own(self, key: str) -> Iterator[tuple[int, int, int]]:
        """(class, place, start) of the line's own blocks."""
        cls = len(key) // CLASS
        for j, s in enumerate(self.starts(len(key), self.block(cls))):
            yield cls, j, s

    def met(self, key: str) -> Iterator[tuple[int, int, int]]:
        """(class, place, start) of the blocks that a line which differs in ``edits`` letters may have as its own."""
        n = len(key)
        for cls in range(max(self.least, n - self.edits) // CLASS, (n + self.edits) // CLASS + 1):
            size = self.block(cls)
            for j, s in enumerate(self.starts(n, size)):
                for shift in range(-self.edits, self.edits + 1) if 0 < j < self.edits else (0,):
                    if 0 <= s + shift <= n - size:
                        yield cls, j, s + shift

    def node_keys(self, mark: str, key: str) -> Iterator[str]:
        """The names of the line's own nodes, after ``mark``."""
        n = len(key)
        places = self.places.get(n)
        if places is None:
            size = self.block(n // CLASS)
            places = self.places[n] = [(f"{cls} {j} ", s, s + size) for cls, j, s in self.own(key)]
        for head, s, e in places:
            yield mark + head + key[s:e]

    def node_columns(self, source: Column, line: Column) -> Column:
        """The hashes of the names of a line's own nodes."""
        n = F.length(line)
        cls = F.floor(n / CLASS).cast("int")
        size = F.floor(F.greatest(cls * CLASS, F.lit(self.least)) / (self.edits + 1)).cast("int")
        place = lambda j: F.floor(F.lit(j) * (n - size) / self.edits).cast("int")
        return F.array(*(F.xxhash64(F.concat_ws(" ", source, cls.cast("string"), F.lit(str(j)), F.substr(line, place(j) + 1, size))) for j in range(self.edits + 1)))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Node:
    """The cores below one node: lines that share a block, found by a block of their rest."""

    def __init__(self, shape: Shape, cls: int):
        self.shape, self.size = shape, shape.rest_block(cls)
        self.below: dict[tuple[int, str], list[int]] = defaultdict(list)
        self.lines: list[tuple[str, str]] = []

    def find(self, rest: str, n: int) -> list[str]:
        """The lines so far that one of n letters with this rest is the same as."""
        met: set[int] = set()
        for j, s in enumerate(self.shape.starts(len(rest), self.size)):
            met.update(self.below.get((j, rest[s : s + self.size]), ()))
        return [line for t in sorted(met) for line, its in [self.lines[t]] if within(rest, its, self.shape.allowed(max(n, len(line))))]

    def add(self, line: str, rest: str) -> None:
        e = self.shape.edits
        for j, s in enumerate(self.shape.starts(len(rest), self.size)):
            for at in {s + shift for shift in (range(-e, e + 1) if 0 < j < e else (0,))}:
                if at >= 0:
                    self.below[j, rest[at : at + self.size]].append(len(self.lines))
        self.lines.append((line, rest))


def _count_lines(batches: Iterator[pa.RecordBatch], least_letters: int) -> Iterator[pa.RecordBatch]:
    """source, text, row (a hash of chunk and text): lines with the number of texts and one of their rows. A row that this
    task has had is not counted again."""
    counts: dict[str, Counter] = defaultdict(Counter)
    last: dict[str, dict[str, int]] = defaultdict(dict)
    had: set[int] = set()

    def flush() -> Iterator[pa.RecordBatch]:
        for source, own in counts.items():
            lines, n, rows = list(own), list(own.values()), last[source]
            for i in range(0, len(lines), 20_000):
                part = lines[i : i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source] * len(part), pa.string()), pa.array(part, pa.string()), pa.array(n[i : i + 20_000], pa.int64()), pa.array([rows[x] for x in part], pa.int64())],
                    names=["source_file", "line", "c", "row"],
                )
        counts.clear()
        last.clear()

    held = 0
    for batch in batches:
        for source, text, row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if row in had:
                continue
            if len(had) < HELD_ROWS:
                had.add(row)
            found = {k for k in text_letters(text) if len(k) >= least_letters}
            counts[source].update(found)
            last[source].update(dict.fromkeys(found, row))
            held += len(found)
            if held > HELD_LINES:
                yield from flush()
                held = 0
    yield from flush()


def _node_rows(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """source, line, count: each line at its own nodes (own true) and where lines that differ from it may have theirs."""
    names = ["node", "source_file", "line", "c", "cls", "at", "own"]
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for source, line, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = set(shape.own(line))
            for cls, j, s in sorted(own | set(shape.met(line))):
                name = f"{source} {cls} {j} {line[s : s + shape.block(cls)]}"
                for col, v in zip(out, (signed(hash_of(name)), source, line, c, cls, s, (cls, j, s) in own)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def _alike(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """From cores sorted by node and falling count: each with the more frequent ones that it is the same as."""
    at: int | None = None
    here: Node | None = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        # a core alone in its node meets none there; the batch's outer nodes may go on
        twice = np.concatenate([[False], keys[1:] == keys[:-1]])
        twice[:-1] |= twice[1:]
        batch = batch.filter(pa.array(twice | (keys == keys[0]) | (keys == keys[-1])))
        out: tuple[list, list, list] = ([], [], [])
        for key, source, line, _, cls, s, own in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if at != key:
                at, here = key, Node(shape, cls)
            rest = line[:s] + line[s + shape.block(cls) :]
            for other in here.find(rest, len(line)):
                if other != line:
                    for col, v in zip(out, (source, line, other)):
                        col.append(v)
            here.add(line, rest)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["source_file", "line", "other"])


def _occurrences(batches: Iterator[pa.RecordBatch], tree: Bitmap, shape: Shape, least_letters: int) -> Iterator[pa.RecordBatch]:
    """Lines with a node, or short lines, that the tree may have. outer: no other line with letters stands above, or none below."""
    may_have, least = tree.may_have, max(1, least_letters)
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_())
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for source, cid, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            mark, keys = source + " ", text_letters(text)
            full = [i for i, k in enumerate(keys, 1) if k]
            for no in full:
                k = keys[no - 1]
                n = len(k)
                if n >= least and (may_have(mark + k) if n < shape.least else any(map(may_have, shape.node_keys(mark, k)))):
                    for column, v in zip(out, (source, cid, no, k, no in (full[0], full[-1]))):
                        column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["source_file", "chunk_id", "line_no", "line", "outer"])


def _same(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, templates = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        yield batch.filter(pa.array([within(x, t, shape.allowed(max(len(x), len(t)))) for x, t in zip(lines, templates)], pa.bool_()))


def repeated_lines(
    chunks: DataFrame, min_chunks: int = 5, min_share: float = 0.1, core: float = 0.125, fuzzy_from: int = 20, edits: int = 2, least_letters: int = 1
) -> DataFrame:
    """source_file, chunk_id, line_no, template, outer, support: each line whose template is in at least ``min_chunks``
    chunks and ``min_share`` of all chunks of its source. A line near several templates has a row for each;
    ``outer`` says that it is the first or the last line with letters.

    A template is a spelling that two chunks and ``core`` of the chunks asked for have, and that is not the same
    as a more frequent one which is itself like none. Nulls in source_file, chunk_id or text leave the row out; repeated rows count once;
    lines without letters are never matched.
    """
    ship(chunks.sparkSession)
    shape = Shape(fuzzy_from, edits)
    rows = chunks.select("source_file", "chunk_id", "text").filter(
        F.col("source_file").isNotNull() & F.col("chunk_id").isNotNull() & F.col("text").isNotNull()
    )
    sizes = rows.select("source_file", "chunk_id").distinct().groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    sizes = stage(sizes.select("source_file", F.greatest(F.lit(float(min_chunks)), F.lit(min_share) * F.col("n")).alias("need")), "p3-sizes")
    counted = rows.select("source_file", "text", F.xxhash64("chunk_id", "text")).mapInArrow(
        lambda it: _count_lines(it, max(1, least_letters)), "source_file string, line string, c bigint, row bigint"
    )
    spelled = counted.groupBy("source_file", "line").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("parts"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    # a line of one row only, which is repeated in several tasks, occurs once
    spelled = spelled.filter("c > 1 and not (lo = hi and c = parts)")
    cores = stage(spelled.join(sizes, "source_file").filter(F.col("c") >= F.lit(core) * F.col("need")).select("source_file", "line", "c", "need"), "p3-cores")
    is_long = F.length("line") >= shape.least
    short = cores.filter(~is_long & (F.col("c") >= F.col("need"))).select("source_file", "line", F.col("line").alias("template"))
    nodes = stage(
        cores.filter(is_long).select("source_file", "line", "c").mapInArrow(lambda it: _node_rows(it, shape), "node bigint, source_file string, line string, c bigint, cls int, at int, own boolean"),
        "p3-nodes",
    )
    alike = stage(
        nodes.repartition("node").sortWithinPartitions("node", F.desc("c"), "line", "at").mapInArrow(lambda it: _alike(it, shape), "source_file string, line string, other string").distinct(),
        "p3-alike",
    )
    # what is the same as a core that is like no more frequent one is no template of its own
    like_none = alike.join(alike.select("source_file", F.col("line").alias("other")).distinct(), ["source_file", "other"], "left_anti")
    absorbed = like_none.select("source_file", "line").distinct()
    tree = stage(nodes.join(absorbed, ["source_file", "line"], "left_anti").select("source_file", "node", F.col("line").alias("template")).distinct(), "p3-tree")
    hashes = tree.select("node").unionByName(short.select(F.xxhash64(F.concat_ws(" ", "source_file", "line")).alias("node")))
    held = chunks.sparkSession.sparkContext.broadcast(Bitmap.of(hashes, BITMAP_BLOCKS))
    seen = stage(rows.mapInArrow(lambda it: _occurrences(it, held.value, shape, least_letters), "source_file string, chunk_id string, line_no int, line string, outer boolean"), "p3-seen")
    each = seen.filter(is_long).select("source_file", "line").distinct()
    at = each.select("source_file", "line", F.explode(shape.node_columns(F.col("source_file"), F.col("line"))).alias("node"))
    known = at.join(tree.select("node", "template"), "node").select("source_file", "line", "template").distinct().mapInArrow(lambda it: _same(it, shape), "source_file string, line string, template string")
    matched = stage(seen.join(known.unionByName(short), ["source_file", "line"]).select("source_file", "chunk_id", "line_no", "template", "outer"), "p3-matched").distinct()
    support = matched.select("source_file", "template", "chunk_id").distinct().groupBy("source_file", "template").agg(F.count(F.lit(1)).alias("support"))
    frequent = support.join(sizes, "source_file").filter(F.col("support") >= F.col("need")).select("source_file", "template", "support")
    return matched.join(frequent, ["source_file", "template"]).select("source_file", "chunk_id", "line_no", "template", "outer", "support")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, dropped = [], []
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            gone = set(drop or ())
            dropped.append(len(gone))
            texts.append("\n".join(x for i, x in enumerate(text.split("\n"), 1) if i not in gone) if gone and text is not None else text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(dropped, pa.int32())], names=["chunk_id", "text", "dropped"])


def without_repeated_lines(chunks: DataFrame, **how: float) -> DataFrame:
    """Every chunk's text without its repeated lines, and how many were dropped."""
    found = repeated_lines(chunks, **how)
    drop = found.select("chunk_id", "line_no").distinct().groupBy("chunk_id").agg(F.sort_array(F.collect_list("line_no")).alias("drop"))
    texts = chunks.select("chunk_id", "text").repartition("chunk_id").distinct()  # one exchange for both
    return texts.join(drop, "chunk_id", "left").select("chunk_id", "text", "drop").mapInArrow(_without, "chunk_id string, text string, dropped int")
