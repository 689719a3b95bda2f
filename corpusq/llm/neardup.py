"""Problem 4: near-duplicate records with small edits.

A text is the set of its three-token shingles, each a point on a ring of hash values. For two
sets A and B of similarity t or more, the Hamming distance |A xor B| is at most
(1 - t) / (1 + t) * (|A| + |B|). Two filters follow from this, both by the pigeonring principle and
neither losing a pair:

1. Candidates. The boxes of the ring are the arcs between neighbouring points, so a box is a pair of
   consecutive shingles and its content is equal in A and B unless a differing point lies on it. A
   point of A alone spoils two boxes of A, a point of B alone one. So at least 3 * overlap - |A| - |B|
   >= (3t/(1+t) - 1) * (|A| + |B|) chains of two consecutive shingles occur in both with no difference
   at all. Of each text only its rarest boxes, all but that number, need to be looked up (plus
   ``matches``, if so many common boxes are asked for).
2. Pruning. The ring is also cut into 16 segments of equal arc, each with a 16-bit parity code of its
   points, whose bit distance is a lower bound of the segment's differences. A pair lives only if from
   some segment on, round the ring, each chain of l segments stays within l/16 of the budget.

The sizes and codes lie in files of the shared folder (44 bytes a text), where the task that meets two texts in a box
looks them up: what shares a box by chance grows as the square of the corpus and is neither moved nor written. If the
shared folder is no mounted one, all such pairs are written and pruned afterwards.

What is left is compared by the exact sets of token triples.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import local_folder, ship, stage
from .split import has_words

TOKEN = re.compile("[а-яёa-z0-9]+")
SEGMENTS, BITS = 16, 16
#: A shingle in at least this share of the texts of some partition counts as common (for the order of boxes only).
COMMON = 0.0003
#: At most so many common shingles are sent to every task (12 bytes each).
COMMON_ROWS = 1_000_000
#: The owners of a box with a longer run are compared in pairs of blocks of about so many, and pruned before a pair leaves.
LONG_RUN = 2048
#: Rows of boxes that one task should sort.
TASK_BOXES = 1_000_000
#: A pair is looked at if it shares so many boxes (a hash collision may spoil up to three of ``matches``).
ASKED = 3
#: Below so many shingles two similar texts may share fewer boxes than ``matches``.
SMALL = 18
#: Rows of boxes looked at together, and pairs compared together, in one task.
RUN_ROWS = 300_000
PAIRS_AT_ONCE = 200_000
#: Texts whose codes lie in one file (44 bytes each).
FILE_TEXTS = 250_000
#: A list of candidate texts up to this long (16 bytes each) may be broadcast.
BROADCAST_ROWS = 500_000


def shingle_arrays(texts: list[str], size: int = 3) -> list[np.ndarray]:
    """The sorted distinct 32-bit hashes of each text's runs of ``size`` tokens."""
    ids: dict[str, int] = {}
    flat: list[int] = []
    bounds = [0]
    for t in texts:
        for w in TOKEN.findall(t.lower()):
            h = ids.get(w)
            if h is None:
                h = ids[w] = xxhash.xxh64_intdigest(w)
            flat.append(h)
        bounds.append(len(flat))
    a = np.array(flat, np.uint64)
    if len(a) < size:
        return [np.empty(0, np.uint32) for _ in texts]
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(a) - size + 1, np.uint64)
        for k in range(size):
            mixed = (mixed ^ a[k : len(a) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    mixed = mixed.astype(np.uint32)
    return [np.unique(mixed[b : max(b, e - size + 1)]) for b, e in zip(bounds, bounds[1:])]


def ring_code(points: np.ndarray) -> np.ndarray:
    """16 segments of the ring, each a 16-bit parity code of the points in it."""
    seg, bit = points >> np.uint32(28), (points >> np.uint32(8)) & np.uint32(15)
    odd = np.bincount(seg * BITS + bit, minlength=SEGMENTS * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint16)


def chain_survives(code_a: np.ndarray, code_b: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """For rows of ring codes: does a chain start anywhere that keeps the proportional budget at every length?"""
    diff = np.unpackbits((code_a ^ code_b).view(np.uint8), axis=1).reshape(len(code_a), SEGMENTS, BITS).sum(axis=2)
    twice = np.concatenate([diff, diff], axis=1)
    share = budget[:, None] / SEGMENTS
    alive = np.ones((len(diff), SEGMENTS), bool)
    total = np.zeros((len(diff), SEGMENTS))
    for length in range(1, SEGMENTS + 1):
        total += twice[:, length - 1 : length - 1 + SEGMENTS]
        alive &= total <= share * length + 1e-9
    return alive.any(axis=1)


def _signatures(batches: Iterator[pa.RecordBatch], size: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts = part.column(1).to_pylist()
            enough = pa.array([has_words(t, min_words) for t in texts], pa.bool_())
            part = part.filter(enough)
            sets = shingle_arrays(part.column(1).to_pylist(), size)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint32)
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int32))),
                    pa.array([ring_code(s).tobytes() for s in sets], pa.binary()),
                    part.column(2),
                ],
                names=["chunk_id", "fp", "n", "points", "code", "text_hash"],
            )


def _locally_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in a large share of this partition's texts; at most (mean shingles a text) / COMMON of them."""
    rows, held, kept = 0, [], np.empty(0, np.int64)
    counts = np.empty(0, np.int64)

    def merge() -> None:
        nonlocal kept, counts, held
        if held:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            both = np.concatenate([kept, k])
            kept, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, c])).astype(np.int64)
            held = []
            # lossy counting: what is far below its share so far is forgotten
            keep = counts >= COMMON * rows / 2
            kept, counts = kept[keep], counts[keep]

    for batch in batches:
        rows += batch.num_rows
        held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        if sum(map(len, held)) > 4_000_000:
            merge()
    merge()
    keep = counts >= max(2, COMMON * rows)
    yield pa.RecordBatch.from_arrays([pa.array(kept[keep]), pa.array(counts[keep]), pa.array(np.full(keep.sum(), rows))], names=["p", "c", "rows"])


def _boxes(batches: Iterator[pa.RecordBatch], common: np.ndarray, counts: np.ndarray, t: float, matches: int) -> Iterator[pa.RecordBatch]:
    """The rarest boxes of each text: key and owner. A set that this task has seen is not sent again."""
    seen: set[int] = set()
    for batch in batches:
        keys, owners = [], []
        fps = batch.column(0).to_numpy()
        points = batch.column(2)
        values = points.flatten().to_numpy(zero_copy_only=False)
        offsets = points.offsets.to_numpy() - points.offsets[0].as_py()
        at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        weight = np.where(common[at] == values, counts[at], 1).astype(np.float64) if len(common) else np.ones(len(values))
        u = values.view(np.uint32).astype(np.uint64)
        for i, fp in enumerate(fps.tolist()):
            b, e = offsets[i], offsets[i + 1]
            n = e - b
            if n < 2 or fp in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add(fp)
            x, w = u[b:e], weight[b:e]
            with np.errstate(over="ignore"):
                key = (((x << np.uint64(32)) | np.roll(x, -1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            order = w * np.roll(w, -1)
            common_boxes = int(np.ceil((3 * t / (1 + t) - 1) * (1 + t) * n - 1e-9))
            send = min(n, n - common_boxes + matches)
            if send < n:
                key = key[np.lexsort((key, order))[:send]]
            if n < SMALL:  # such a pair may share a single box only: each counts as many as are asked for
                with np.errstate(over="ignore"):
                    key = np.concatenate([key + np.int64(j * 0x632BE59BD9B4E019) for j in range(ASKED)])
            keys.append(key)
            owners.append(np.full(len(key), fp, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "fp"])


def write_codes(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """From (part, fp, n, code) sorted by part and fp: a file a part with fps, codes and sizes, one after the other."""
    at: int | None = None
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        fp = np.concatenate([h[0] for h in held])
        first = np.concatenate([[True], fp[1:] != fp[:-1]])
        code, n = (np.concatenate([h[i] for h in held])[first] for i in (1, 2))
        os.makedirs(folder, exist_ok=True)
        own = f"{folder}/{uuid.uuid4().hex}.tmp"  # a task that runs twice leaves one whole file
        with open(own, "wb") as f:
            f.write(fp[first].tobytes() + code.tobytes() + n.tobytes())
        os.replace(own, f"{folder}/{at}")
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(n)], pa.int64())], names=["part", "rows"])

    for batch in batches:
        part = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for s, e in zip(cut, cut[1:]):
            if s == e:
                continue
            if part[s] != at:
                if held:
                    yield close()
                at, held = int(part[s]), []
            own = batch.slice(s, e - s)
            held.append((own.column(1).to_numpy(), np.frombuffer(b"".join(own.column(3).to_pylist()), np.uint64).reshape(-1, 4), own.column(2).to_numpy()))
    if held:
        yield close()


class Codes:
    """Size and ring code by fp, from the mapped files of ``write_codes``; only what a task asks for is read."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts, self.open = folder, parts, {}

    def __call__(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n and code (four words) of ``fps``, which are sorted."""
        n, code = np.empty(len(fps), np.int32), np.empty((len(fps), 4), np.uint64)
        part = ((fps.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)
        cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(fps)]
        for s, e in zip(cut, cut[1:]):
            p = int(part[s])
            if p not in self.open:
                path = f"{self.folder}/{p}"
                rows = os.path.getsize(path) // 44
                self.open[p] = [np.memmap(path, t, "r", at * rows, shape) for t, at, shape in ((np.int64, 0, (rows,)), (np.uint64, 8, (rows, 4)), (np.int32, 40, (rows,)))]
            known, codes, sizes = self.open[p]
            at = np.searchsorted(known, fps[s:e])
            n[s:e], code[s:e] = sizes[at], codes[at]
        return n, code


def _alive(na: np.ndarray, nb: np.ndarray, ca: np.ndarray, cb: np.ndarray, t: float) -> np.ndarray:
    """Which pairs (sizes, codes as four words) pass the size and chain filters."""
    na, nb = na.astype(float), nb.astype(float)
    # two texts with hash collisions could differ by more in truth than here, never by less
    budget = np.floor((1 - t) / (1 + t) * (na + nb) + 1e-9)
    ok = np.minimum(na, nb) >= t * np.maximum(na, nb) - 1
    ok &= np.bitwise_count(ca ^ cb).sum(axis=1) <= budget  # the whole ring is the last of the chains
    left = np.flatnonzero(ok)
    if len(left):
        words = lambda c: np.ascontiguousarray(c[left]).view(np.uint16)
        ok[left] = chain_survives(words(ca), words(cb), budget[left])
    return ok


def _runs(batches: Iterator[pa.RecordBatch], long_run: int, t: float, codes: Codes | None = None) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: pairs of owners of one box; owners of boxes with long runs go out unpaired (b null).

    With ``codes`` only pairs that pass the size and chain filters go out. Texts that share a box by chance, as many as
    the square of the corpus, then stay in the task that meets them.
    """
    long_key: int | None = None

    def emit(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        column = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), column(b), column(key)], names=["a", "b", "key"])

    def pairs(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((f, k))
        k, f = k[order], f[order]
        once = np.concatenate([[True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])])
        k, f = k[once], f[once]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        lengths = np.diff(np.append(starts, len(k)))
        far = lengths > long_run
        if long_key is not None:
            far |= k[starts] == long_key
        out = np.repeat(far, lengths)
        if out.any():
            yield emit(f[out], None, k[out])
        near = np.repeat(~far & (lengths > 1), lengths)
        if not near.any():
            return
        f = f[near]
        multi = lengths[~far & (lengths > 1)]
        begins = np.cumsum(multi) - multi
        if codes is not None:
            own, place = np.unique(f, return_inverse=True)
            n, code = codes(own)
        for length in np.unique(multi).tolist():
            left, right = np.triu_indices(length, 1)
            runs = begins[multi == length]
            some = max(1, PAIRS_AT_ONCE // len(left))
            for at in range(0, len(runs), some):
                for cut in range(0, len(left), PAIRS_AT_ONCE):
                    i = (runs[at : at + some, None] + left[None, cut : cut + PAIRS_AT_ONCE]).ravel()
                    j = (runs[at : at + some, None] + right[None, cut : cut + PAIRS_AT_ONCE]).ravel()
                    if codes is not None:
                        pi, pj = place[i], place[j]
                        ok = _alive(n[pi], n[pj], code[pi], code[pj], t)
                        i, j = i[ok], j[ok]
                    if len(i):
                        yield emit(f[i], f[j], None)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows < RUN_ROWS:
            continue
        k, f = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        first = int(np.searchsorted(k, k[-1]))  # the last run may go on in the next batch
        if first:
            yield from pairs(k[:first], f[:first])
        held, rows = [(k[first:], f[first:])], len(k) - first
        if rows > 4 * long_run:  # it is long anyway: send it on now
            fs = np.unique(f[first:])
            long_key = int(k[-1])
            yield emit(fs, None, np.full(len(fs), long_key))
            held, rows = [], 0
    if rows:
        yield from pairs(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))


def _chains(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, 4) for i in (4, 5)]
        alive = _alive(batch.column(2).to_numpy(), batch.column(3).to_numpy(), *codes, t)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(alive)), batch.column(1).filter(pa.array(alive))], names=["a", "b"])


def _block_pairs(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """From owners sorted by (key, lo, hi): pairs of the two blocks that pass the size and chain filters, once a key."""
    at: tuple | None = None
    rows: list[tuple] = []

    def pairs() -> Iterator[pa.RecordBatch]:
        _, lo, hi = at
        left = [r for r in rows if r[0] == lo]
        right = left if lo == hi else [r for r in rows if r[0] == hi]
        if not left or not right:
            return
        fp, n, code = np.array([r[1] for r in right], np.int64), np.array([r[2] for r in right], float), np.frombuffer(b"".join(r[3] for r in right), np.uint16).reshape(-1, SEGMENTS)
        for i, (_, f, m, c) in enumerate(left):
            rest = slice(i + 1, None) if lo == hi else slice(None)
            other, size = fp[rest], n[rest]
            fit = np.minimum(size, m) >= t * np.maximum(size, m) - 1
            mine = np.repeat(np.frombuffer(c, np.uint16)[None], fit.sum(), axis=0)
            fit[fit] = chain_survives(mine, code[rest][fit], np.floor((1 - t) / (1 + t) * (m + size[fit]) + 1e-9))
            if fit.any():
                other = other[fit]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, f)), pa.array(np.maximum(other, f))], names=["a", "b"])

    for batch in batches:
        for key, lo, hi, side, fp, n, code in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if at != (key, lo, hi):
                if at is not None:
                    yield from pairs()
                at, rows = (key, lo, hi), []
            rows.append((side, fp, n, code))
    if at is not None:
        yield from pairs()


def components(links: DataFrame, name: str) -> DataFrame:
    """node, root for each node of ``links`` (a, b): the least node of its component.

    Every node is moved to the least of its neighbours, by turns of the greater and of the lesser ones (large and
    small stars); each turn is written to the shared folder, and the number of turns grows as the logarithm of the
    longest chain.
    """

    def turn(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a: the centre, b: a neighbour; a star of lesser neighbours takes only those below its centre
        near = both if large else both.filter("b < a")
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = near.join(least, "a")
        out = moved.filter("b > a" if large else "b <> m").select("b", "m")
        own = moved.select(F.col("a").alias("b"), "m")
        ends = (out if large else out.unionByName(own)).filter("b <> m").select(F.least("b", "m").alias("a"), F.greatest("b", "m").alias("b"))
        return stage(ends.distinct(), name)

    sums = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
    edges = stage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    seen = None
    while seen != (now := sums(edges)):
        seen = now
        edges = turn(turn(edges, True), False)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _verify(batches: Iterator[pd.DataFrame], t: float, size: int) -> Iterator[pd.DataFrame]:
    def triples(text: str) -> set:
        tk = TOKEN.findall(text.lower())
        return set(zip(*(tk[i:] for i in range(size))))

    for pdf in batches:
        keep, sims = [], []
        for i, (ta, tb) in enumerate(zip(pdf["ta"], pdf["tb"])):
            a, b = triples(ta), triples(tb)
            both = len(a & b)
            union = len(a) + len(b) - both
            if union and both >= t * union - 1e-12:
                keep.append(i)
                sims.append(both / union)
        out = pdf.iloc[keep][["a", "b"]]
        yield out.assign(similarity=np.array(sims, float))


class NearDuplicates:
    """Texts of at least ``min_words`` words whose sets of ``size``-token shingles are ``t`` similar.

    ``members``: chunk_id, fp - the class of texts with equal shingle sets that each chunk is in (its
    representative is the class). ``pairs``: a, b (fps, a < b), similarity - every pair of different
    classes at or over t; pairs of copies follow from members and are not spelled out.
    Repeated rows count once; null texts or ids, and texts without a shingle, are in no class.
    """

    def __init__(self, chunks: DataFrame, t: float = 0.7, size: int = 3, min_words: int = 20, matches: int = 6, long_run: int = LONG_RUN):
        spark = chunks.sparkSession
        ship(spark)
        if matches < ASKED + 3:
            raise ValueError(f"matches must be at least {ASKED + 3}")
        texts = chunks.select("chunk_id", "text", F.xxhash64("text").alias("text_hash")).filter(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
        sig = stage(
            texts.mapInArrow(lambda it: _signatures(it, size, min_words), "chunk_id string, fp bigint, n int, points array<int>, code binary, text_hash bigint").filter("n > 0"),
            "p4-signatures",
        )
        self.members = sig.select("chunk_id", "fp").distinct()
        held = spark.sparkContext.broadcast(self._common(sig))
        boxes = sig.select("fp", "n", "points").mapInArrow(lambda it: _boxes(it, *held.value, t, matches), "key bigint, fp bigint")
        shingles, rows = sig.agg(F.sum("n"), F.count(F.lit(1))).collect()[0]
        # as many tasks as keep each of one size, however many texts there are
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(shingles or 0) // TASK_BOXES))
        folder, parts = local_folder(spark, "p4-codes"), -(-rows // FILE_TEXTS) or 1
        if folder:
            high = F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), 32)
            coded = sig.select(F.shiftright(high * F.lit(parts), 32).cast("int").alias("part"), "fp", "n", "code")
            coded.repartition(parts, "part").sortWithinPartitions("part", "fp").mapInArrow(lambda it: write_codes(it, folder), "part int, rows bigint").agg(F.sum("rows")).collect()
        met_in = lambda it: _runs(it, long_run, t, Codes(folder, parts) if folder else None)
        runs = stage(boxes.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(met_in, "a bigint, b bigint, key bigint"), "p4-runs")
        light = sig.groupBy("fp").agg(F.first("n").alias("n"), F.first("code").alias("code"), F.min(F.struct("chunk_id", "text_hash")).alias("one"))
        long = runs.filter("b is null").select("key", F.col("a").alias("fp")).distinct()
        blocks = long.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / long_run).cast("int").alias("blocks"))
        sides = long.join(blocks, "key").join(light.select("fp", "n", "code"), "fp").withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        each = sides.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("side", "o").alias("lo"), F.greatest("side", "o").alias("hi"), "side", "fp", "n", "code")
        met = each.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "fp").mapInArrow(lambda it: _block_pairs(it, t), "a bigint, b bigint")
        found = runs.filter("b is not null").select("a", "b").unionByName(met)
        counted = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")).filter(F.col("common") >= ASKED)
        la = light.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("code").alias("ca"))
        lb = light.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("code").alias("cb"))
        pruned = counted.join(la, "a").join(lb, "b")
        alive = stage(
            pruned.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(lambda it: _chains(it, t), "a bigint, b bigint"),
            "p4-candidates",
        )
        ids = alive.select(F.col("a").alias("fp")).union(alive.select(F.col("b").alias("fp"))).distinct()
        needed = light.join(ids, "fp", "left_semi").select("fp", "one.chunk_id", "one.text_hash")
        small = alive.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2
        text = texts.join(F.broadcast(needed) if small else needed, ["chunk_id", "text_hash"]).select("fp", "text").dropDuplicates(["fp"])
        self.pairs = (
            alive.join(text.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a")
            .join(text.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")
            .mapInPandas(lambda it: _verify(it, t, size), "a bigint, b bigint, similarity double")
        )

    @staticmethod
    def _common(sig: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Shingles that may be common, with counts; their number is bounded, so it may go to the driver."""
        local = sig.select("points").mapInArrow(_locally_common, "p bigint, c bigint, rows bigint")
        total = sig.count()
        # at most 2 * (mean shingles a text) / COMMON rows; beyond the limit the rarest are left out, which only costs speed
        kept = local.groupBy("p").agg(F.sum("c").alias("c")).filter(F.col("c") >= COMMON / 2 * total)
        got = kept.orderBy(F.desc("c"), "p").limit(COMMON_ROWS).toArrow()
        p, c = got.column(0).to_numpy().astype(np.int32), got.column(1).to_numpy()
        order = np.argsort(p)
        return p[order], c[order]

    def chunk_pairs(self) -> DataFrame:
        """chunk_a < chunk_b: all pairs of different chunks, those of equal shingle sets among them."""
        m = self.members
        equal = m.select("fp", F.col("chunk_id").alias("chunk_a")).join(m.select("fp", F.col("chunk_id").alias("chunk_b")), "fp").filter("chunk_a < chunk_b")
        x = m.select(F.col("fp").alias("a"), F.col("chunk_id").alias("ca"))
        y = m.select(F.col("fp").alias("b"), F.col("chunk_id").alias("cb"))
        other = self.pairs.join(x, "a").join(y, "b")
        return equal.select("chunk_a", "chunk_b").unionByName(
            other.select(F.least("ca", "cb").alias("chunk_a"), F.greatest("ca", "cb").alias("chunk_b"))
        ).distinct()

    def groups(self) -> DataFrame:
        """One row a chunk: chunk_id, class_id (the least chunk_id with its shingles), links (other classes that are near
        duplicates of it), group_id (the least chunk_id that near-duplicates lead to). A chunk_id with several texts has a row for each."""
        pairs = stage(self.pairs.select("a", "b"), "p4-pairs")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = both.groupBy(F.col("a").alias("fp")).agg(F.count(F.lit(1)).alias("links"))
        roots = components(pairs, "p4-stars").select(F.col("node").alias("fp"), "root")
        classes = self.members.groupBy("fp").agg(F.min("chunk_id").alias("class_id")).join(links, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = classes.groupBy("root").agg(F.min("class_id").alias("group_id"))
        known = classes.join(least, "root").select("fp", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), "group_id")
        return self.members.join(known, "fp").select("chunk_id", "class_id", "links", "group_id")
