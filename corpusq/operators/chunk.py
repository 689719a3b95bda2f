"""Word-window chunking: one text to many overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

SIZE, OVERLAP, LEAST = 400, 50, 30


def windows(df: DataFrame, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``df`` with window_no, start_word and body for each window of its text, without the text.

    Windows start every size - overlap words, so the last may lie wholly in the one before. A text
    without words has none.
    """
    step = size - overlap
    w = df.withColumn("_w", words(F.col(text))).filter(F.size("_w") > 0)
    last = F.floor((F.size("_w") - 1) / step).cast("int")
    rows = w.withColumn("window_no", F.explode(F.sequence(F.lit(0), last)))
    body = F.array_join(F.slice("_w", F.col("window_no") * step + 1, size), " ")
    return rows.withColumns({"start_word": F.col("window_no") * step, "body": body}).drop("_w", text)


def chunk_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Chunks of pages (document_id, source_file, page, text, image_path).

    A page of fewer than ``least`` characters gives a placeholder of type image; windows shorter than that
    are dropped, so a longer page of mere white space vanishes. Null text counts as empty.
    """
    p = pages.withColumn("text", F.coalesce("text", F.lit("")))
    short = p.filter(F.length("text") < least).select(
        "document_id", "source_file", "page", "image_path", F.lit(0).alias("window_no"),
        F.concat(F.lit("[Страница "), F.col("page").cast("string"), F.lit(" из "), F.col("source_file"), F.lit("]")).alias("text"),
        F.lit("image").alias("type"),
    )
    full = windows(p.filter(F.length("text") >= least), "text").filter(F.length("body") >= least)
    return full.select("document_id", "source_file", "page", "image_path", "window_no", F.col("body").alias("text"), F.lit("text").alias("type")).unionByName(short)


def chunk_flow(docs: DataFrame, words_a_page: int = 300, least: int = LEAST) -> DataFrame:
    """Chunks of texts without pages (document_id, source_file, text); the page follows from the window's first word."""
    out = windows(docs, "text").filter(F.length("body") >= least)
    page = (F.floor(F.col("start_word") / words_a_page) + 1).cast("int")
    return out.select("document_id", "source_file", page.alias("page"), "window_no", F.col("body").alias("text"))


def chunk_id(document: Column, no: Column) -> Column:
    return F.concat(document.cast("string"), F.lit("_c"), no.cast("string"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_no in order of page and window within a document, and the id made of both."""
    no = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "window_no", "text")) - 1
    return chunks.withColumn("chunk_no", no).withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("chunk_no")))
