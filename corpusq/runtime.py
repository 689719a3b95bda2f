"""Session helpers: staging in the shared folder, shipping the package, table reading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED = "_corpusq_shipped"
_STAGED: set[str] = set()
_KEPT: dict[tuple, object] = {}
T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where none is set and the session is of one machine; elsewhere it's an error,
    as executors on other machines wouldn't see it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusq-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def staged_dir(spark: SparkSession) -> str:
    """This application's folder of staged tables, removed when the driver ends."""
    path = f"{shared_dir(spark)}/corpusq/{spark.sparkContext.applicationId}"
    if path not in _STAGED:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop)
        fs.deleteOnExit(hadoop)
        _STAGED.add(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, and what is read more than once is computed once. The table
    survives the loss of executors, as it lies in the shared folder.
    """
    spark = df.sparkSession
    path = f"{staged_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_folder(spark: SparkSession, name: str) -> str | None:
    """A new name in the folder of staged tables as a path that Python can open, or None if that folder isn't mounted."""
    scheme, _, path = staged_dir(spark).rpartition(":")
    return f"/{path.lstrip('/')}/{name}-{uuid.uuid4().hex}" if scheme in ("", "file") else None


def clear_staged(spark: SparkSession) -> None:
    """Remove all staged tables now; what was derived from them can't be read any more."""
    path = staged_dir(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _STAGED.discard(path)
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]


def kept(spark: SparkSession, key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once for an application: the collection and its index, as they are after ingestion.

    It is made anew if the application's staged tables were removed meanwhile.
    """
    full = (spark.sparkContext.applicationId, *key)
    if full in _KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(staged_dir(spark))
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            clear_staged(spark)
    if full not in _KEPT:
        _KEPT[full] = make()
    return _KEPT[full]


def forget(spark: SparkSession, key: tuple) -> None:
    """``kept`` makes it anew next time."""
    _KEPT.pop((spark.sparkContext.applicationId, *key), None)


def numbered(df: DataFrame, order: list, name: str, col: str = "place") -> DataFrame:
    """``df`` with the place of each row in a total order, from 1, without a window over all rows: the rows are sorted by
    range, numbered within their partition, and each partition starts after those before it."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    sorted_rows = stage(part, name)
    here = Window.partitionBy("_part").orderBy("_row")
    sizes = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # as many rows as partitions
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    out = sorted_rows.join(F.broadcast(before), "_part")
    return out.withColumn(col, (F.col("_before") + F.row_number().over(here)).cast("int")).drop("_part", "_row", "_before")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't share our path."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="corpusq-code-"), "corpusq.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("corpusq", os.path.relpath(full, root)))
    sc.addPyFile(target)
    setattr(sc, _SHIPPED, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: So many hashes of repeated rows (8 bytes each) may be sent to every task.
REPEATED_ROWS = 500_000


def once(df: DataFrame, name: str) -> DataFrame:
    """The distinct rows of ``df``. Hashes say which may be repeated, and only those are exchanged, unless they are many."""
    hashed = df.withColumn("_h", F.xxhash64(*df.columns))
    again = stage(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_h"), name)
    if again.limit(REPEATED_ROWS + 1).count() > REPEATED_ROWS:
        return stage(df.distinct(), name)
    single = hashed.join(F.broadcast(again), "_h", "left_anti").drop("_h")
    return single.unionByName(stage(hashed.join(F.broadcast(again), "_h", "left_semi").drop("_h").distinct(), name))


#: So many rows of hits or places in a graph (some hundred bytes each) may be sent to every task.
HIT_ROWS = 50_000


def sent(df: DataFrame) -> DataFrame:
    """A written table for a join with one that holds texts: broadcast if it has few rows, so that no text is exchanged."""
    return F.broadcast(df) if df.limit(HIT_ROWS + 1).count() <= HIT_ROWS else df


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows if there are at most ``limit``, else None (never more than limit + 1 are sent)."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


Query = Callable[[SparkSession, str], DataFrame]
