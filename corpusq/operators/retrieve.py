"""Fusion, hybrid and graph-assisted retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import ranked

RRF_K = 60


def rrf_merge(first: DataFrame, second: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, key, rank): query_id, key, score, rank.

    The best fused score of a query is scaled to 1. Ties go to the smaller rank in the first list, then in the second.
    """
    both = first.select("query_id", key, F.col("rank").alias("r1"), F.lit(None).cast("int").alias("r2")).unionByName(
        second.select("query_id", key, F.lit(None).cast("int").alias("r1"), F.col("rank").alias("r2"))
    )
    term = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    merged = both.groupBy("query_id", key).agg(F.min("r1").alias("r1"), F.min("r2").alias("r2")).withColumn("rrf", F.round(term("r1") + term("r2"), 12))
    best = F.max("rrf").over(Window.partitionBy("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.coalesce("r1", F.lit(1 << 30)), F.coalesce("r2", F.lit(1 << 30)), key)
    return merged.withColumns({"score": F.round(F.col("rrf") / best, 4), "rank": F.row_number().over(w)}).filter(F.col("rank") <= k).select("query_id", key, "score", "rank")


def rrf_merge_as_written(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The fusion whose keys never meet: the two lists alternate, the first list's hit before the second's."""
    both = first.select("query_id", "chunk_id", "rank", F.lit(0).alias("list")).unionByName(second.select("query_id", "chunk_id", "rank", F.lit(1).alias("list")))
    w = Window.partitionBy("query_id").orderBy("rank", "list")
    least = F.min("rank").over(Window.partitionBy("query_id"))
    out = both.withColumns({"place": F.row_number().over(w), "score": F.round((RRF_K + least) / (RRF_K + F.col("rank")), 4)})
    return out.filter(F.col("place") <= k).select("query_id", "chunk_id", "list", "score", F.col("place").alias("rank"))


def graph_retrieve(near: DataFrame, best: DataFrame, k: int = 7, each: int = 3) -> DataFrame:
    """Graph-assisted hits: query_id, chunk_id, score, via, rank.

    ``near``: scored chunks of each question's graph pages (query_id, p: the page's place, chunk_id, score, text), of
    which the ``each`` best of a page are taken, each text once. ``best``: the question's best chunks of all (query_id,
    chunk_id, score, rank, text), which fill the places up to k. All are ordered by score.
    """
    on_page = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "p").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("r") <= each)
    first = on_page.withColumn("d", F.row_number().over(Window.partitionBy("query_id", "text").orderBy("p", "r"))).filter("d = 1")
    held = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"))
    rest = best.join(first.select("query_id", "text"), ["query_id", "text"], "left_anti").join(held, "query_id")
    once = rest.withColumn("d", F.row_number().over(Window.partitionBy("query_id", "text").orderBy("rank"))).filter("d = 1")
    fill = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) + F.col("held")).filter(F.col("place") <= k)
    pick = lambda df, via: df.select("query_id", "chunk_id", "score", F.lit(via).alias("via"))
    return ranked(pick(first, "graph").unionByName(pick(fill, "vector")), k)


def keep_matching_or_all(df: DataFrame, match: Column, by: str | None = None) -> DataFrame:
    """Rows that match, or all (of the group) if none does."""
    m = F.coalesce(match, F.lit(False))
    w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(1))
    return df.withColumns({"_m": m, "_any": F.max(m).over(w)}).filter("_m or not _any").drop("_m", "_any")


def format_context(hits: DataFrame) -> DataFrame:
    """Per query: its hits' texts in rank order, each under its [document:page]."""
    block = F.concat(F.lit("["), F.col("document_id"), F.lit(":"), F.coalesce(F.col("page"), F.lit(0)).cast("string"), F.lit("]\n"), F.col("text"))
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return got.select("query_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def offline_answer(query: Column, context: Column, most: int = 3000) -> Column:
    """The answer without a model: the found passages, cut."""
    cut = F.when(F.length(context) > most, F.concat(F.substring(context, 1, most), F.lit("…"))).otherwise(context)
    return F.concat_ws("\n", F.lit("**Запрос:**"), query, F.lit("---"), F.lit("**Найденные отрывки:**"), cut)
