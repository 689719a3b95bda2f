"""Files to a collection: typing, reading, routing, chunking, embedding, store and registry rows in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..operators import chunk, detect, store, vector
from ..runtime import stage
from ..sources import files, providers


def ingest_files(spark: SparkSession, folder: str, target: str, ocr: providers.OcrProvider | None = None, embedder: vector.Embedder | None = None) -> DataFrame:
    """All documents of ``folder`` into the store at ``target``, which is made anew; a document's id is its file's stem.

    Pages with too little text go to ``ocr`` by their image's name; texts without pages are cut as a flow. Returns the
    registry rows: document_id, name, status, error_msg, doc_type, strategy, text_chunks, images, total_pages.
    """
    name = basename(F.col("path"))
    raw = files.read_documents(spark, folder).withColumns({"name": name, "document_id": F.regexp_replace(name, "\\.[^.]+$", ""), "source_file": name})
    raw = stage(raw, "read")
    typed = raw.select("document_id", "name", detect.type_by_extension(F.col("name")).alias("t")).distinct()
    probed = detect.type_by_pages(raw.filter("page is not null"), "document_id", "page", "text").select("document_id", F.col("doc_type").alias("p_type"), F.col("strategy").alias("p_strategy"))
    image = F.concat(F.substring("document_id", 1, 20), F.format_string("_p%04d.jpg", F.col("page")))
    pages = raw.filter("page is not null").select("document_id", "source_file", "page", "text", image.alias("image_path"))
    if ocr is not None:
        need = pages.filter(detect.route(F.col("text")) == "ocr")
        read, _ = providers.read_pages(need.drop("text"), spark.createDataFrame([], "image_path string, text string"), ocr)
        pages = pages.filter(detect.route(F.col("text")) == "direct").unionByName(read.withColumnRenamed("raw_text", "text"))
    flow = chunk.chunk_flow(raw.filter("page is null and text is not null").select("document_id", "source_file", "text"))
    made = chunk.chunk_pages(pages).unionByName(flow.withColumns({"type": F.lit("text"), "image_path": F.lit("")}))
    numbered = stage(chunk.number_chunks(made), "numbered")
    embedded = vector.embed_with(numbered, "chunk_id", embedder or vector.HashingEmbedder())
    store.recreate(numbered.join(embedded, "chunk_id"), target)
    errors = raw.groupBy("document_id").agg(F.max("error").alias("error_msg"))
    stats = store.ingest_stats(numbered).drop("distinct_images")
    out = typed.join(probed, "document_id", "left").join(errors, "document_id").join(stats, "document_id", "left").fillna(0, ["text_chunks", "images", "total_pages"])
    return out.select(
        "document_id", "name", F.when(F.col("error_msg").isNull(), "indexed").otherwise("error").alias("status"), "error_msg",
        F.coalesce("t.doc_type", "p_type").alias("doc_type"), F.coalesce("t.strategy", "p_strategy").alias("strategy"), "text_chunks", "images", "total_pages",
    )
