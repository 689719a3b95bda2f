"""Documents as they arrive: a file stream whose batches replace the chunks of their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunk, store

PAGES = "document_id string, source_file string, page int, text string, image_path string"


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Pages (parquet files of ``PAGES``) to chunks in ``target``, in buckets by document (``store.read_documents``).

    A batch replaces its documents whole, so a batch that is run again after a failure changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        named = batch.filter(F.col("document_id").isNotNull())
        if not named.isEmpty():
            store.write_documents(spark, chunk.number_chunks(chunk.chunk_pages(named)), target, named)

    stream = spark.readStream.schema(PAGES).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
