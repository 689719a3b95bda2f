"""Tables of the store: replacement and deletion by document, registry state, caches, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import stage


def replace_by_document(old: DataFrame, new: DataFrame, replaced: DataFrame) -> DataFrame:
    """Old rows of documents not in ``replaced`` (document_id), and all new rows. A document that was extracted
    anew without any chunk must be in ``replaced``, or its stale chunks would stay."""
    return old.join(replaced.select("document_id").distinct(), "document_id", "left_anti").select(old.columns).unionByName(new.select(old.columns))


def delete_by_document(old: DataFrame, gone: DataFrame) -> DataFrame:
    return old.join(gone.select("document_id").distinct(), "document_id", "left_anti").select(old.columns)


#: Buckets of a chunk store: a document's chunks are in the one that its id gives, so the number of folders is fixed.
BUCKETS = 256


def bucket_of(document: Column) -> Column:
    return F.pmod(F.xxhash64(document), F.lit(BUCKETS)).cast("int")


def write_documents(spark: SparkSession, chunks: DataFrame, path: str, replaced: DataFrame) -> None:
    """Replace the chunks of the documents in ``replaced`` (document_id) by ``chunks``; other documents stay.

    Only the buckets concerned are read and written anew, by one overwrite of partitions; a document without new
    chunks just isn't in them any more. No list of documents comes to the driver.
    """
    ids = replaced.select("document_id").filter("document_id is not null").distinct()
    new = chunks.withColumn("bucket", bucket_of(F.col("document_id")))
    touched = ids.select(bucket_of(F.col("document_id")).alias("bucket")).distinct()
    old_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if old_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(old_path):
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(touched), "bucket", "left_semi")  # at most BUCKETS rows
        stay = old.join(ids, "document_id", "left_anti").select(new.columns)
        # a bucket that becomes empty keeps one row without a document, which a read leaves out
        mark = touched.select(*(F.col("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema)).select(new.columns)
        new = new.unionByName(stay).unionByName(mark)
    stage(new, "documents").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("document_id is not null").drop("bucket")


def recreate(chunks: DataFrame, path: str) -> None:
    """Drop the whole store and write ``chunks``."""
    chunks.withColumn("bucket", bucket_of(F.col("document_id"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def cached_ocr(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with their cached text, pages that miss), by image_path."""
    c = cache.select("image_path", F.col("text").alias("cached"))
    return pages.join(c, "image_path"), pages.join(c, "image_path", "left_anti")


def latest_state(events: DataFrame) -> DataFrame:
    """Last status and progress of each document; of events at one moment the greatest status counts."""
    last = F.max(F.struct("ts", "status", F.coalesce("progress", F.lit("")).alias("progress"))).alias("x")
    return events.groupBy("document_id").agg(last, F.countDistinct("ts", "status").alias("changes")).select("document_id", "x.status", "x.ts", "x.progress", "changes")


def can_index(status: Column) -> Column:
    """What an indexing request leads to: a document that is being indexed rejects it."""
    return F.when(status == "indexing", "rejected").otherwise("indexing")


def advance(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Registry rows (id, status, progress, error_msg) after one event each (id, event, message).

    ask: pending, with progress and error cleared, unless it is being indexed; start: indexing; done: indexed; fail: error
    with the message cut to 1000 characters. The last column says whether the event was taken.
    """
    e, busy = F.col("event"), F.col("status") == "indexing"
    taken = F.when(e == "ask", ~busy).when(e == "start", F.col("status") == "pending").when(e.isin("done", "fail"), busy).otherwise(False)
    to = lambda value, *names: F.when(F.col("taken") & e.isin(*names), value)
    out = documents.select("id", "status", "progress", "error_msg").join(events, "id", "left").withColumn("taken", F.coalesce(taken, F.lit(False)))
    status = F.coalesce(to(F.lit("pending"), "ask"), to(F.lit("indexing"), "start"), to(F.lit("indexed"), "done"), to(F.lit("error"), "fail"), F.col("status"))
    progress = F.when(F.col("taken") & (e == "ask"), "").when(F.col("taken") & (e == "start"), "Начало обработки…").when(F.col("taken") & (e == "done"), "Индексация завершена").otherwise(F.col("progress"))
    error = F.when(F.col("taken") & (e == "ask"), "").when(F.col("taken") & (e == "fail"), F.substring("message", 1, 1000)).otherwise(F.col("error_msg"))
    return out.select("id", "event", status.alias("status"), progress.alias("progress"), error.alias("error_msg"), "taken")


def ingest_stats(chunks: DataFrame) -> DataFrame:
    """Per document: text chunks, rows with an image, distinct images, last page (0 if none)."""
    img = F.when(F.length("image_path") > 0, F.col("image_path"))
    return chunks.groupBy("document_id").agg(
        F.count_if(F.col("type") == "text").alias("text_chunks"),
        F.count(img).alias("images"),
        F.count_distinct(img).alias("distinct_images"),
        F.coalesce(F.max("page"), F.lit(0)).alias("total_pages"),
    )
