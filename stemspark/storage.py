"""Storage shared by driver and executors, and broadcasts behind a check of their size."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a two-long lookup side is broadcast (checked by a count first); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Makes Spark delete an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='stemspark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python, once a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_stemspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="stemspark-"), "stemspark_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    context._stemspark_shipped = True


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: cuts the lineage and survives lost executors. The shuffle files
    behind it go as soon as it is written. dictionary: whether Parquet tries dictionaries, which are lost work on hashes."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what stored() wrote of these tables. Nothing that is still to be computed may read them."""
    for table in tables:
        if path := getattr(table, "_stored_at", None):
            remove(table.sparkSession, path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves it has at most `limit` (narrow) rows; else df, and the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with its rows' ranks by column `by` (from 1) in column `name`: ranges are dealt out and sorted, and only their sizes, a
    row a range, are summed in one place."""
    ranged = df.repartitionByRange(by).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "numbered")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return ranged.join(F.broadcast(sizes), "_range").withColumn(name, (F.col("_before") + inside).cast("int")).drop("_range", "_before")
