"""Inverted index and BM25."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..runtime import bounded_rows, ship, stage

K1, B, EPSILON = 1.5, 0.75, 0.25


#: So many terms of questions (about 60 bytes each) may be sent to every task.
QUESTION_TERMS = 200_000
#: Chunks and tokens of a block of the index; at most 65,536 chunks, as their places are 16-bit numbers.
BLOCK_CHUNKS, BLOCK_TOKENS = 2000, 1_000_000
#: Questions scored together against a block.
QUESTIONS_AT_ONCE = 500

_BLOCK = "block string, term string, n int, at binary, tf binary, ids array<{}>, dl array<bigint>"


@dataclass
class LexicalIndex:
    """blocks: an inverted index by block of chunks. A block's first row has no term, but its chunks' ids and lengths (dl);
    then comes a row a term, in order: n chunks have it, at (16-bit places in ids) and tf (32-bit) say which and how often.
    terms(term, df, idf), corpus(n, avgdl): one row."""

    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame


def _blocks(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, block_chunks: int) -> Iterator[pa.RecordBatch]:
    """From (chunk_id, tokens or null, block): the rows of blocks."""
    ids: list = []
    dl: list[int | None] = []
    found: dict[str, tuple[list[int], list[int]]] = {}
    name, tokens, turn = "", 0, 0

    def close() -> Iterator[pa.RecordBatch]:
        terms = sorted(found)
        block = f"{name}-{turn}"
        at = [np.array(found[t][0], np.uint16).tobytes() for t in terms]
        tf = [np.array(found[t][1], np.int32).tobytes() for t in terms]
        rows = len(terms) + 1
        for s in range(0, rows, 5000):
            here = slice(max(s - 1, 0), s + 4999)
            head = [None] if s == 0 else []
            n = len(terms[here]) + len(head)
            lead = lambda x, kind: pa.array([x, *[None] * (n - 1)] if head else [None] * n, pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * n, pa.string()),
                    pa.array(head + terms[here], pa.string()),
                    pa.array(head + [len(found[t][0]) for t in terms[here]], pa.int32()),
                    pa.array(head + at[here], pa.binary()),
                    pa.array(head + tf[here], pa.binary()),
                    lead(ids, id_type),
                    lead(dl, pa.int64()),
                ],
                names=["block", "term", "n", "at", "tf", "ids", "dl"],
            )

    for batch in batches:
        for i, words, of in zip(*(batch.column(c).to_pylist() for c in range(3))):
            name = of
            for w, c in Counter(words or ()).items():
                places, counts = found.setdefault(w, ([], []))
                places.append(len(ids))
                counts.append(c)
            ids.append(i)
            dl.append(len(words) if words is not None else None)
            tokens += len(words or ())
            if len(ids) >= block_chunks or tokens >= BLOCK_TOKENS:
                yield from close()
                ids, dl, found, tokens, turn = [], [], {}, 0, turn + 1
    if ids:
        yield from close()


def build(chunks: DataFrame, id_col: str = "chunk_id", text: str = "text", block_chunks: int = BLOCK_CHUNKS) -> LexicalIndex:
    """The index of chunks with unique ids, written once. Negative idf becomes EPSILON times the vocabulary's mean idf.

    Texts are tokenised once and stay where they are read: each task writes blocks of its own chunks, in which postings
    are in order of term, and only the terms' counts by block are exchanged.
    """
    ship(chunks.sparkSession)
    id_type = dict(chunks.dtypes)[id_col]
    arrow = pa.string() if id_type == "string" else pa.int64() if id_type == "bigint" else pa.int32()
    # the partition names the block, so a task that runs twice makes the same blocks
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), tokenize(F.col(text)).alias("t"), F.spark_partition_id().cast("string").alias("block"))
    blocks = stage(tokens.mapInArrow(lambda it: _blocks(it, arrow, block_chunks), _BLOCK.format(id_type)), "postings")
    each = blocks.filter("term is null").select(F.explode("dl").alias("dl"))
    corpus = stage(each.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), "corpus")
    df = blocks.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    # corpus and mean are single rows
    raw = stage(df.join(F.broadcast(corpus)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).select("term", "df", "raw"), "terms")
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(blocks, terms, corpus)


def _best(batches: Iterator[pa.RecordBatch], asked: list[tuple[object, list[tuple[str, float]]]], limited: set, k: int, avgdl: float, kinds: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The best k chunks of each question in each block, from the rows of whole blocks, and of the places (``at``) that a
    question with a filter allows (query_id not null)."""
    name: str | None = None
    rows: list[tuple] = []

    def scored() -> Iterator[pa.RecordBatch]:
        ids, dl = next(((r[4], r[5]) for r in rows if r[1] is None and r[6] is None), (None, None))
        if not ids:
            return
        length = np.array([np.nan if x is None else x for x in dl], float)
        norm = K1 * (1 - B + B * length / avgdl)
        parts, allowed = {}, {}
        for _, term, at, tf, _, _, q in rows:
            if q is not None:
                allowed.setdefault(q, []).append(np.frombuffer(at, np.uint16))
            elif term is not None:
                place, count = np.frombuffer(at, np.uint16), np.frombuffer(tf, np.int32).astype(float)
                parts[term] = place, count * (K1 + 1) / (count + norm[place])
        order = np.array(sorted((i for i, x in enumerate(ids) if x is not None), key=ids.__getitem__), np.int64)
        for s in range(0, len(asked), QUESTIONS_AT_ONCE):
            out: tuple[list, list, list] = ([], [], [])
            for q, terms in asked[s : s + QUESTIONS_AT_ONCE]:
                total = np.zeros(len(ids))
                for term, weight in terms:
                    if term in parts:
                        place, part = parts[term]
                        total[place] += weight * part
                total = np.round(total, 4)
                if q in limited:
                    may = np.zeros(len(ids), bool)
                    for p in allowed.get(q, ()):
                        may[p] = True
                    total[~may] = 0
                total = total[order]
                hit = np.flatnonzero(total > 0)
                hit = hit[np.argsort(-total[hit], kind="stable")[:k]]
                out[0].extend([q] * len(hit))
                out[1].extend(ids[i] for i in order[hit])
                out[2].extend(total[hit].tolist())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], kinds[0]), pa.array(out[1], kinds[1]), pa.array(out[2], pa.float64())], names=["query_id", "chunk_id", "score"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if row[0] != name:
                if name is not None:
                    yield from scored()
                name, rows = row[0], []
            rows.append(row)
    if name is not None:
        yield from scored()


def search(index: LexicalIndex, queries: DataFrame, k: int, where: DataFrame | None = None) -> DataFrame:
    """Best k chunks a query (query_id, text): query_id, chunk_id, score (4 places), rank.

    Repeated query terms count again. Only positive scores; ties by chunk_id. ``where``: (query_id, chunk_id) allowed
    for each query that has a filter, applied before the ranking, while idf stays that of the whole corpus.

    The rows of the questions' terms are brought together by block, and each block sends on k chunks a question.
    """
    spark = queries.sparkSession
    q = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    q = stage(q.join(index.terms, "term"), "question-terms")
    few = bounded_rows(q.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")), QUESTION_TERMS)
    if few is None:
        return _search_joined(index, q, k, where)
    (avgdl,) = index.corpus.select("avgdl").collect()[0]
    id_type, q_type = dict(index.blocks.dtypes)["ids"][6:-1], dict(q.dtypes)["query_id"]
    weights: dict = {}
    for r in sorted(few, key=lambda r: r.term):
        weights.setdefault(r.query_id, []).append((r.term, r.w))
    limited = set() if where is None else {r[0] for r in where.select("query_id").distinct().join(F.broadcast(q.select("query_id").distinct()), "query_id").collect()}
    asked = q.select("term").distinct()
    # checked above: few terms
    rows = index.blocks.join(F.broadcast(asked), "term", "left_semi").unionByName(index.blocks.filter("term is null"))
    rows = rows.select("block", "term", "at", "tf", "ids", "dl", F.lit(None).cast(q_type).alias("query_id"))
    if limited:
        places = index.blocks.filter("term is null").select("block", F.posexplode("ids").alias("p", "chunk_id"))
        may = places.join(where, "chunk_id").groupBy("block", "query_id").agg(F.collect_set("p").alias("p"))
        packed = F.unhex(F.array_join(F.transform("p", lambda p: F.concat(F.lpad(F.hex(p % 256), 2, "0"), F.lpad(F.hex(F.floor(p / 256)), 2, "0"))), ""))
        null = lambda c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c)
        rows = rows.unionByName(may.select("block", null("term"), packed.alias("at"), null("tf"), null("ids"), null("dl"), "query_id"))
    kinds = tuple(pa.string() if x == "string" else pa.int64() if x == "bigint" else pa.int32() for x in (q_type, id_type))
    held = spark.sparkContext.broadcast((list(weights.items()), limited))
    best = rows.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _best(it, *held.value, k, avgdl, kinds), f"query_id {q_type}, chunk_id {id_type}, score double")
    return ranked(best.withColumn("score", F.round("score", 4)), k)


def _search_joined(index: LexicalIndex, q: DataFrame, k: int, where: DataFrame | None) -> DataFrame:
    """The search for more terms than may be sent to every task: postings are spelled out and joined by term."""
    id_type = dict(index.blocks.dtypes)["ids"][6:-1]

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 100):
                part = batch.slice(s, 100)
                row = np.repeat(np.arange(part.num_rows), [len(x) // 2 for x in part.column(2).to_pylist()])
                place, count = (np.frombuffer(b"".join(part.column(i).to_pylist()), t).astype(np.int32) for i, t in ((2, np.uint16), (3, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(place), pa.array(count)], names=["block", "term", "p", "tf"])

    postings = index.blocks.filter("term is not null").select("block", "term", "at", "tf").join(q.select("term").distinct(), "term", "left_semi")
    places = index.blocks.filter("term is null").select("block", F.posexplode(F.arrays_zip("ids", "dl")).alias("p", "c")).select("block", "p", F.col("c.ids").alias("chunk_id"), F.col("c.dl").alias("dl"))
    each = postings.select("block", "term", "at", "tf").mapInArrow(spelled, "block string, term string, p int, tf int").join(places, ["block", "p"])
    hits = each.join(q, "term")
    if where is not None:
        filtered = where.select("query_id").distinct()
        hits = hits.join(filtered, "query_id", "left_anti").unionByName(hits.join(where, ["query_id", "chunk_id"], "left_semi").select(hits.columns))
    scored = hits.join(F.broadcast(index.corpus))  # a single row
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    total = scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 4).alias("score")).filter("score > 0")
    return ranked(total, k)


def ranked(scores: DataFrame, k: int | None) -> DataFrame:
    """rank by score, then chunk_id, within a query; Spark keeps k a query before the exchange."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)
