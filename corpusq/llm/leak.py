"""Problem 6: evaluation texts leaking into training text.

Items and documents are sequences of folded words. What counts is (a) a run of words of an item, found by
the hashes of all its windows of that length, or (b) a share of an item's words in order within a stretch.
For (b) a document is cut into overlapping pieces of twice the longest stretch, so that each stretch lies
whole in one of them. A piece can hold a passage only if it has enough of the item's words: of the rarest
``n - need + t`` words of an item of n words at least t must be there, as at most ``n - need`` are missing.
Pieces and items meet by that count in an inverted index, then words are counted in a sliding stretch, then
the longest common subsequence decides. Each step is a necessary condition of the next: no passage is lost.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Latin and other letters that look like Cyrillic ones, lower case; ё is read as е.
LOOKS_LIKE = "aeopcxykmtbhiё"
READ_AS = "аеорсхукмтвніе"
_FOLD = str.maketrans(LOOKS_LIKE, READ_AS, "­​‌‍⁠﻿")
_FOLD_UPPER = str.maketrans("ABEKMHOPCTXY", "АВЕКМНОРСТХУ")
_DIVIDED = re.compile("(\\w)[-¬­‐‑]+[^\\S\n]*\n\\s*(?=\\w)")
_NOT_WORD = re.compile(r"[\W_]+")


def fold(word: str) -> str:
    """A word without case, punctuation, ё or look-alike letters; empty if nothing is left."""
    word = unicodedata.normalize("NFKC", word).translate(_FOLD_UPPER).lower().translate(_FOLD)
    return word if word.isalnum() else _NOT_WORD.sub("", word)


def raw_words(text: str) -> list[str]:
    """Words between white space; those divided at a line end are put together."""
    return (_DIVIDED.sub(r"\1", text) if "\n" in text else text).split()


def folded_words(text: str) -> list[str]:
    return [w for x in raw_words(text) if (w := fold(x))]


def _run_keys(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A hash of the ``window`` words from each start."""
    mult = np.uint64(0x9E3779B97F4A7C15)
    key = np.ones(len(starts), np.uint64)
    for j in range(window):
        key = (key ^ words[starts + j].astype(np.uint64)) * mult
        key ^= key >> np.uint64(31)
    return key


class ItemIndex:
    """The items' words, the hashes of their runs, and postings of their rarest words."""

    #: Postings that are followed at once.
    CELLS = 4_000_000

    def __init__(self, items: list[tuple[int, str]], window: int, share: float, stretch: float):
        self.window = window
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item, text in items:
            self.items.append((item, [self.ids.setdefault(w, len(self.ids) + 1) for w in folded_words(text)]))
        lengths = [len(ws) for _, ws in self.items]
        self.need = [max(1, math.ceil(n * share - 1e-9)) for n in lengths]
        self.span = [int(n * stretch + 1e-9) for n in lengths]
        self.step = max([1, *self.span])
        self.bags = [Counter(ws) for _, ws in self.items]
        self._index_runs()
        self._index_words()

    def _index_runs(self) -> None:
        flat, starts, owner = [], [], []
        for k, (_, ws) in enumerate(self.items):
            for s in range(len(ws) - self.window + 1):
                starts.append(len(flat) + s)
                owner.append(k)
            flat += ws
        words, at, own = np.array(flat or [0], np.int64), np.array(starts, np.int64), np.array(owner, np.int64)
        keys = _run_keys(words, at, self.window)
        order = np.argsort(keys, kind="stable")
        self.run_keys, self.run_owners, self.flat, self.run_starts = keys[order], own[order], words, at[order]

    def _index_words(self) -> None:
        """Postings (word: item, occurrences) of the item's ``n - need + t`` rarest words, t being half of what it needs."""
        held_by = Counter(w for bag in self.bags for w in bag)
        least, rows = [], []
        for k, (_, ws) in enumerate(self.items):
            t = max(1, self.need[k] // 2)
            least.append(t)
            rare = sorted(ws, key=lambda w: (held_by[w], w))[: max(0, len(ws) - self.need[k] + t)]
            rows += [(w, k, c) for w, c in Counter(rare).items()]
        rows.sort()
        word, self.post_item, self.post_count = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.post_at = np.searchsorted(word, np.arange(len(self.ids) + 2))
        self.least = np.array(least, np.int64)

    def runs(self, words: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) with a run of ``window`` words of the item. ``words``: ids, 0 between documents; ``doc``: whose they are."""
        w = self.window
        known = np.concatenate([[0], np.cumsum(words > 0)])
        at = np.flatnonzero(known[w:] - known[:-w] == w)
        key = _run_keys(words, at, w)
        lo, hi = np.searchsorted(self.run_keys, key, "left"), np.searchsorted(self.run_keys, key, "right")
        out: set[tuple[int, int]] = set()
        for i in np.flatnonzero(hi > lo):
            for j in range(lo[i], hi[i]):
                pair, s = (int(doc[at[i]]), int(self.run_owners[j])), self.run_starts[j]
                if pair not in out and np.array_equal(words[at[i] : at[i] + w], self.flat[s : s + w]):
                    out.add(pair)
        return out

    def pieces(self, words: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, piece, item) where the piece has as many of the item's rarest words as a passage can't do without."""
        at = np.flatnonzero(words > 0)
        if not len(at) or not len(self.post_item):
            return
        # piece k goes from k to k + 2 steps; a word is in the piece that begins before it and in the one before that
        wide, no = int(place.max()) // self.step + 1, place[at] // self.step
        piece = doc[at] * wide + no
        back = no > 0
        piece, word = np.concatenate([piece, piece[back] - 1]), np.concatenate([words[at], words[at][back]])
        cell, count = np.unique(piece * (len(self.ids) + 1) + word, return_counts=True)
        piece, word = np.divmod(cell, len(self.ids) + 1)
        posts = self.post_at[word + 1] - self.post_at[word]
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        cost = np.cumsum(np.add.reduceat(posts, first))
        cuts = [*first[np.flatnonzero(np.diff(cost // self.CELLS, prepend=-1))], len(piece)]
        for a, b in zip(cuts, cuts[1:]):
            n = posts[a:b]
            row = np.repeat(np.arange(a, b), n)
            post = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.post_at[word[row]]
            low = piece[a]
            pair = (piece[row] - low) * len(self.items) + self.post_item[post]
            both = np.minimum(self.post_count[post], count[row])
            if (piece[b - 1] - low + 1) * len(self.items) > self.CELLS:
                pair, back_to = np.unique(pair, return_inverse=True)
                both = np.bincount(back_to, both)
            else:
                both = np.bincount(pair, both)
                pair = np.flatnonzero(both)
                both = both[pair]
            for x in pair[both >= self.least[pair % len(self.items)]].tolist():
                p, k = divmod(x, len(self.items))
                yield *divmod(p + int(low), wide), k

    def leaks(self, docs: list[list[int]]) -> list[tuple[int, int]]:
        """(document, item), both by place in their lists."""
        words = np.array([w for d in docs for w in (*d, 0)], np.int64)
        if not len(words) or not self.ids:
            return []
        lengths = np.array([len(d) + 1 for d in docs])
        doc = np.repeat(np.arange(len(docs)), lengths)
        place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = self.runs(words, doc)
        for d, p, k in self.pieces(words, doc, place):
            if (d, k) not in out and self.holds(docs[d][p * self.step : (p + 2) * self.step], k):
                out.add((d, k))
        return sorted(out)

    def holds(self, d: list[int], k: int) -> bool:
        """Exact: enough of the item's words in order within its stretch."""
        ws, bag, need, span = self.items[k][1], self.bags[k], self.need[k], self.span[k]
        at = [i for i, x in enumerate(d) if x in bag]
        if all(b - a >= span for a, b in zip(at, at[need - 1 :])):
            return False
        places: dict[int, list[int]] = defaultdict(list)
        for j, x in enumerate(ws):
            places[x].append(j)
        have: Counter = Counter()
        common = first = 0
        for last, b in enumerate(at):
            have[d[b]] += 1
            common += have[d[b]] <= bag[d[b]]
            while at[first] <= b - span:
                x = d[at[first]]
                common -= have[x] <= bag[x]
                have[x] -= 1
                first += 1
            if common >= need and _common([d[i] for i in at[first : last + 1]], places, len(ws)) >= need:
                return True
        return False


def _common(xs: list[int], places: dict[int, list[int]], n: int) -> int:
    """Length of the longest common subsequence, as the longest increasing run of places (Hunt and Szymanski)."""
    from bisect import bisect_left

    ends: list[int] = []
    for x in xs:
        for j in reversed(places[x]):
            k = bisect_left(ends, j)
            if k == len(ends):
                ends.append(j)
            else:
                ends[k] = j
    return len(ends)


def _search(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    ids_of: dict[str, int] = {}  # as written: id in the items, 0 for other words, -1 for none

    def word_ids(text: str) -> list[int]:
        out = []
        for x in raw_words(text):
            i = ids_of.get(x)
            if i is None:
                w = fold(x)
                i = index.ids.get(w, 0) if w else -1
                if len(ids_of) < 500_000:
                    ids_of[x] = i
            if i >= 0:
                out.append(i)
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids = part.column(0).to_pylist()
            lists = [word_ids(t) for t in part.column(1).to_pylist()]
            hits = [(ids[d], index.items[k][0]) for d, k in index.leaks(lists)]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["doc_id", "item_id"])


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    window: int = 12,
    share: float = 2 / 3,
    stretch: float = 1.5,
    block: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id): documents with ``window`` consecutive words of an item, or ``share`` of its words
    in order within ``stretch`` times its length.

    The items are a stated query set, taken in blocks of ``block`` items by item_id; each block's index
    goes to every task (a proven bound), and one pass over the documents serves a block. Documents are
    never shuffled. Null texts and ids are left out; an item of fewer words than the window counts only
    by its share; repeated rows give one result.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    out, last = spark.createDataFrame([], "doc_id bigint, item_id bigint"), None
    while True:
        # an item_id may have several texts, so a block goes on after the last id and text
        left = asked if last is None else asked.filter((F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("text") > last[1])))
        rows = left.orderBy("item_id", "text").limit(block).collect()
        if not rows:
            return out.distinct()
        held = spark.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in rows], window, share, stretch))
        out = out.union(docs.mapInArrow(lambda it, h=held: _search(it, h.value), "doc_id bigint, item_id bigint"))
        last = rows[-1]
        if len(rows) < block:
            return out.distinct()
