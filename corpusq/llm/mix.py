"""Problem 7: mix sources to target weights.

Sizes are tokens of a public tokenizer. Temperature mixing: a source's token share (its tokens, as often as
they may be used) is exponentiated. With targets the weights are target ** e * share ** (1 - e), with the
largest exponent e in [0, 1] at which the budget needs no source more often than its limit; a target entropy
takes share ** e with the exponent that meets it. Exponents are found by bisection. Weights become whole
texts by budgeted block permutations: texts in a pseudo-random order of blocks, whole rounds first, then
blocks up to the budget.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import bounded_rows, ship, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the tokenizer splits a text before its ranks apply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts a block holds on average; a source's last, cut block is the only one that is ordered text by text.
BLOCK_TEXTS = 500
MAX_SOURCES = 100_000


def source_name(col):
    """One spelling for a source: lower case, no outer spaces, hyphens for underscores."""
    return F.regexp_replace(F.lower(F.trim(col)), "[_\\s]+", "-")


def _load(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = None
    for batch in batches:
        coder = coder or _load(path)
        n = [len(coder.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(n, pa.int64())], names=["doc_id", "source", "same", "tokens"])


def entropy_of(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(fits, lo: float, hi: float) -> float:
    """The largest x in [lo, hi] that fits, if all below it do; ``lo`` must."""
    if fits(hi):
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def solve_weights(
    tokens: dict[str, float], targets: dict[str, float], repeats: dict[str, int], budget: float | None = None, entropy: float | None = None
) -> tuple[dict[str, float], float, float]:
    """Weights by source, the budget in tokens and the exponent.

    Sources without text get no weight; the others' targets are scaled to 1. Without a budget it is the largest
    at which every weight is met exactly; one over all limits is cut to them. With ``entropy`` (in nats) the
    weights are share ** e, e in [0, 1] as large as the entropy allows: 1 mixes in proportion, 0 evenly. Then a
    budget that needs a source more often than its limit is cut to what the weights allow.
    """
    have = {s: targets[s] for s in targets if tokens.get(s, 0) > 0 and (targets[s] > 0 or entropy is not None) and repeats[s] > 0}
    if not have:
        return {}, 0.0, 1.0
    limit = {s: tokens[s] * repeats[s] for s in have}
    room = sum(limit.values())
    share = {s: x / room for s, x in limit.items()}

    def scaled(raw: dict[str, float]) -> dict[str, float]:
        z = sum(raw.values())
        return {s: v / z for s, v in raw.items()}

    most = lambda w: min(limit[s] / w[s] for s in w)
    if entropy is not None:
        at = lambda e: scaled({s: x**e for s, x in share.items()})
        e = bisect(lambda x: entropy_of(at(x)) >= entropy - 1e-12, 0.0, 1.0)
        w = at(e)
        return w, min(most(w), room if budget is None else budget), e
    want = scaled(have)
    at = lambda e: scaled({s: want[s] ** e * share[s] ** (1 - e) for s in want})
    budget = min(most(want) if budget is None else budget, room)
    e = bisect(lambda x: all(w * budget <= limit[s] * (1 + 1e-12) for s, w in at(x).items()), 0.0, 1.0)
    return at(e), budget, e


class Mixture:
    """``plan``: doc_id, source, tokens, times - how often each text is taken. ``shares``: one row a source.

    Equal texts are one text (its least doc_id), in the source that allows the fewest repeats, so no text
    passes any of its sources' limits; repeated rows count once. Null texts, ids and sources, and
    sources without a target, take no part. A target without texts is reported with a share of 0. A
    source's size misses its budget by less than one text. ``budget``: tokens of the mixture, or of it for each
    token of the sources if ``relative``; ``entropy``: share of the greatest entropy, in place of the targets.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, budget: float | None = None, relative: bool = False, entropy: float | None = None, tokenizer: str = TOKENIZER, seed: int = 42):
        spark = documents.sparkSession
        ship(spark)
        named = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null").dropDuplicates(["source"])
        rows = bounded_rows(named, MAX_SOURCES)
        if rows is None:
            raise ValueError(f"more than {MAX_SOURCES} targets")
        want = {r[0]: float(r[1] or 0) for r in rows}
        often = {r[0]: int(r[2] or 0) for r in rows}
        same = F.sha2(F.col("text"), 256)
        limits = spark.createDataFrame([(s, often[s]) for s in want] or [("", 0)], "source string, max_repeats int")
        named_texts = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
        # as many rows as there are targets, at most MAX_SOURCES
        texts = named_texts.filter("doc_id is not null and text is not null").join(F.broadcast(limits.select("source")), "source")
        sized = texts.select("doc_id", "source", "text", same.alias("same")).mapInArrow(
            lambda it: _sizes(it, tokenizer), "doc_id bigint, source string, same string, tokens bigint"
        )
        one = (
            sized.filter("tokens > 0")
            .join(F.broadcast(limits), "source")
            .groupBy("same")
            .agg(F.min(F.struct("max_repeats", "source", "doc_id", "tokens")).alias("x"))
            .select("x.source", "x.doc_id", "x.tokens")
        )
        one = stage(one, "p7-sizes")
        totals = {r[0]: (r[1], r[2]) for r in one.groupBy("source").agg(F.sum("tokens"), F.count(F.lit(1))).collect()}
        tokens = {s: t for s, (t, _) in totals.items()}
        if entropy is not None:
            entropy *= math.log(max(1, len(tokens)))
        if relative and budget is not None:
            budget *= sum(tokens.values())
        weights, self.budget, self.exponent = solve_weights(tokens, want, often, budget, entropy)
        rounds, rest = {}, {}
        for s, (t, _) in totals.items():
            part = min(weights.get(s, 0.0) * self.budget, t * often[s])
            rounds[s] = int(part // t)
            rest[s] = part - rounds[s] * t
        per = [(s, rounds[s], float(rest[s]), max(1, -(-totals[s][1] // BLOCK_TEXTS))) for s in totals]
        budgets = spark.createDataFrame(per or [("", 0, 0.0, 1)], "source string, rounds int, rest double, blocks long")
        mixed = F.xxhash64(F.lit(seed), "source", "doc_id")
        placed = one.join(F.broadcast(budgets), "source").withColumns({"block": F.pmod(mixed, F.col("blocks")), "place": F.xxhash64(F.lit(seed + 1), "doc_id")})
        in_order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block")
        blocks = placed.groupBy("source", "block").agg(F.sum("tokens").alias("size")).withColumn("upto", F.sum("size").over(in_order))
        before = blocks.select("source", "block", (F.col("upto") - F.col("size")).alias("before"), "upto")
        known = placed.join(before, ["source", "block"])
        whole = known.filter("upto <= rest").withColumn("extra", F.lit(1))
        none = known.filter("before > rest").withColumn("extra", F.lit(0))
        within = Window.partitionBy("source", "block").orderBy("place", "doc_id")
        cut = (
            known.filter("upto > rest and before <= rest")
            .withColumn("sum", F.sum("tokens").over(within))
            .withColumn("extra", (F.col("before") + F.col("sum") <= F.col("rest")).cast("int"))
            .drop("sum")
        )
        taken = whole.unionByName(none).unionByName(cut).withColumn("times", F.col("rounds") + F.col("extra")).filter("times > 0")
        self.plan = taken.select("doc_id", "source", "tokens", "times")
        got = self.plan.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("taken"), F.count(F.lit(1)).alias("texts"), F.max("times").alias("most"))
        had = spark.createDataFrame(
            [(s, want[s], often[s], totals.get(s, (0, 0))[0], totals.get(s, (0, 0))[1], float(weights.get(s, 0.0))) for s in want] or [("", 0.0, 0, 0, 0, 0.0)],
            "source string, target_share double, max_repeats int, source_tokens bigint, source_texts bigint, weight double",
        )
        joined = had.join(got, "source", "left").fillna(0, ["taken", "texts", "most"])
        self.shares = joined.withColumn("reached_share", F.coalesce(F.try_divide(F.col("taken"), F.sum("taken").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))
