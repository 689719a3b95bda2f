"""Document typing and page routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension

TEXT_PAGE, TEXT_SHARE, HYBRID_SHARE = 150, 0.70, 0.35


def type_by_extension(name: Column, djvu_tool: bool = False) -> Column:
    """Struct of doc_type, strategy and coverage; a pdf is left to its pages, so its type is null."""
    ext = extension(name)
    make = lambda t, s, c: F.struct(F.lit(t).cast("string").alias("doc_type"), F.lit(s).cast("string").alias("strategy"), F.lit(c).cast("double").alias("coverage"))
    return (
        F.when(ext == ".docx", make("docx", "text_only", 1.0))
        .when(ext == ".doc", make("doc", "text_only", 1.0))
        .when(ext == ".djvu", make("djvu", "direct" if djvu_tool else "vlm", None))
        .when(ext == ".pdf", make(None, None, None))
        .otherwise(make("unknown", "vlm", None))
    )


def type_by_pages(pages: DataFrame, key: str, order: str, text: str, least: int = TEXT_PAGE) -> DataFrame:
    """Per document: type and strategy by the share of sampled pages that hold text.

    Every step-th page from the first, ten at most, with step = max(1, pages // 10).
    """
    w = Window.partitionBy(key).orderBy(order)
    lengths = pages.select(key, order, F.length(F.trim(text)).alias("len"), F.xxhash64(text).alias("same")).distinct()  # no text is moved
    numbered = lengths.select(key, "len", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    sampled = numbered.filter((F.col("i") % step == 0) & (F.col("i") / step < 10))
    got = sampled.groupBy(key).agg(
        F.round(F.avg(F.when(F.col("len") >= least, 1.0).otherwise(0.0)), 3).alias("text_coverage"),
        F.round(F.avg(F.coalesce("len", F.lit(0))), 1).alias("avg_chars"),
        F.count(F.lit(1)).alias("sample_pages"),
    )
    c = F.col("text_coverage")
    return got.withColumns(
        {
            "doc_type": F.when(c >= TEXT_SHARE, "text_pdf").when(c >= HYBRID_SHARE, "hybrid_pdf").otherwise("scan_pdf"),
            "strategy": F.when(c >= HYBRID_SHARE, "hybrid").otherwise("vlm"),
        }
    )


def route(text: Column, least: int = TEXT_PAGE) -> Column:
    return F.when(F.length(F.trim(text)) >= least, "direct").otherwise("ocr")
