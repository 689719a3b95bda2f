"""Embeddings and exact vector search."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .lexical import ranked

DIM = 64


class Embedder(Protocol):
    """Texts to vectors; ``kind`` is passage or query. Runs in executors, in batches of 50."""

    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


def hashed_vector(text: Column, dim: int = DIM) -> Column:
    """Offline embedding in the JVM: token counts by md5 bucket, array of doubles; length isn't normalised."""
    buckets = F.transform(tokenize(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.reduce(buckets, zero, lambda v, b: F.transform(v, lambda x, i: F.when(i == b, x + 1.0).otherwise(x)))


def hashed_counts(texts: DataFrame, id_col: str, dim: int = DIM) -> DataFrame:
    """The same embedding as rows (id, bucket, x): token counts add up by groupBy, with map-side sums."""
    t = texts.select(id_col, F.explode(tokenize(F.col("text"))).alias("t"))
    bucket = F.pmod(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    return t.groupBy(id_col, bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("x"))


def dense(counts: DataFrame, id_col: str, name: str = "v", dim: int = DIM) -> DataFrame:
    """Rows to one array of ``dim`` doubles an id."""
    got = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"))
    return got.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias(name))


def hashed_rows(texts: DataFrame, id_col: str, name: str = "v", dim: int = DIM) -> DataFrame:
    """The same, one row a text with a token; ids are unique, so nothing is exchanged."""
    kind = dict(texts.dtypes)[id_col]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = functools.lru_cache(500_000)(lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim)
        for batch in it:
            rows = [i for i, t in enumerate(batch.column(1).to_pylist()) if t]
            v = np.zeros((len(rows), dim))
            for k, t in enumerate(batch.column(1).take(pa.array(rows, pa.int64())).to_pylist()):
                v[k] = np.bincount([bucket(w) for w in t], minlength=dim)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), flat], names=[id_col, name])

    return texts.select(id_col, tokenize(F.col("text")).alias("t")).mapInArrow(run, f"{id_col} {kind}, {name} array<double>")


def embed_with(texts: DataFrame, id_col: str, embedder: Embedder, kind: str = "passage", batch: int = 50) -> DataFrame:
    """(id, embedding) by a provider, keyed by id, never by position."""
    kind_of = dict(texts.dtypes)[id_col]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({id_col: part[id_col], "embedding": embedder.embed(part["text"].fillna("").tolist(), kind)})

    return texts.select(id_col, "text").mapInPandas(run, f"{id_col} {kind_of}, embedding array<float>")


class HashingEmbedder:
    """The offline stand-in for a model: as ``hashed_vector``, of unit length."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def embed(self, texts: list[str], kind: str) -> list[list[float]]:
        import re

        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in re.findall("[а-яёa-z0-9]+", t.lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1
            out.append((v / (np.linalg.norm(v) or 1)).astype(np.float32).tolist())
        return out


def _packed(id_col: str, v_col: str, rows: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of vectors as blocks: ids, and unit vectors as the bytes of one matrix. Zero vectors are left out."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows].sort_values(id_col, kind="stable")
                m = np.stack(part[v_col].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(m, axis=1)
                keep = norm > 0
                if keep.any():
                    yield pd.DataFrame({"ids": [part[id_col].to_numpy()[keep].tolist()], "m": [(m[keep] / norm[keep, None]).tobytes()]})

    return run


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """Exact cosine top-k: vectors (chunk_id, v), queries (query_id, q) -> query_id, chunk_id, score, rank.

    Both sides become blocks of ``block`` vectors, and each block of the stated queries meets each block of vectors in
    one plan: one matrix product, of which at most k rows a query go on. Scores have 4 places; ties by chunk_id. Zero
    or null vectors never match.
    """
    id_type, q_type = dict(vectors.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    left = queries.filter("q is not null and query_id is not null").select("query_id", "q").mapInPandas(_packed("query_id", "q", block), f"ids array<{q_type}>, m binary")
    right = vectors.filter("v is not null and chunk_id is not null").select("chunk_id", "v").mapInPandas(_packed("chunk_id", "v", block), f"ids array<{id_type}>, m binary")
    met = left.select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m")).crossJoin(right)

    def best(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for q_ids, q_m, ids, m in zip(pdf["q_ids"], pdf["q_m"], pdf["ids"], pdf["m"]):
                q, e = np.frombuffer(q_m).reshape(len(q_ids), -1), np.frombuffer(m).reshape(len(ids), -1)
                r = np.round(q @ e.T, 4)
                least = np.partition(r, -k, axis=1)[:, -k] if k < r.shape[1] else np.full(len(r), -np.inf)
                row, col = np.nonzero(r >= least[:, None])  # ids are sorted, so are the columns
                order = np.lexsort((col, -r[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < k], col[place < k]
                yield pd.DataFrame({"query_id": np.asarray(q_ids, dtype=object)[row], "chunk_id": np.asarray(ids, dtype=object)[col], "score": r[row, col]})

    return ranked(met.mapInPandas(best, f"query_id {q_type}, chunk_id {id_type}, score double").withColumn("score", F.round("score", 4)), k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, 4 places; null for a zero vector."""
    dot = lambda x, y: F.reduce(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.round(F.try_divide(F.try_divide(dot(a, b), F.sqrt(dot(a, a))), F.sqrt(dot(b, b))), 4)
