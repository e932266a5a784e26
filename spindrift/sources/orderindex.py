"""Tables kept in order, with an index that says which rows each file holds.

A file's rows lie between two values of the order column, and the index counts
them, so a page anywhere is read from the file or two that it lies in.  A table
whose new rows all follow the old ones, as links do by their ids, grows by more
files and more index rows.

    <path>/rows/part=p/...    sorted files
    <path>/index/part=p       (file, first, last, n, start), a row for each file
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000


def write_ordered(df: DataFrame, path: str, order: str = "id", rows_per_file: int = ROWS_PER_FILE) -> None:
    """The rows, sorted by a unique column, and their index."""
    _append(df, path, order, rows_per_file, 0, 0)


def append_ordered(df: DataFrame, path: str, order: str = "id", rows_per_file: int = ROWS_PER_FILE) -> None:
    """More rows, all behind those that are there; the files that are there are not read."""
    known = read_index(df.sparkSession, path).agg(
        F.max("part").alias("part"), F.max("last").alias("last"), F.coalesce(F.max(F.col("start") + F.col("n")), F.lit(0)).alias("n")
    ).first()
    if known.last is not None and not df.filter(F.col(order) <= F.lit(known["last"])).isEmpty():
        raise ValueError(f"{order} must lie behind {known['last']}")
    _append(df, path, order, rows_per_file, (known.part or 0) + 1, known.n)


def _append(df: DataFrame, path: str, order: str, rows_per_file: int, part: int, start: int) -> None:
    spark, rows = df.sparkSession, f"{path}/rows/part={part}"
    df.repartitionByRange(order).sortWithinPartitions(order).write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(rows)
    stored = spark.read.schema(df.schema).parquet(rows).select(F.col("_metadata.file_name").alias("file"), F.col(order).alias("at"))
    files = stored.groupBy("file").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    # One row for each file.
    before = F.coalesce(F.sum("n").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("start", before + start).coalesce(1).write.mode("overwrite").parquet(f"{path}/index/part={part}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def rows_at(spark: SparkSession, path: str, start: int, n: int, order: str = "id") -> DataFrame:
    """``n`` rows from the ``start``-th on, read from the files that hold them."""
    index = read_index(spark, path)
    found = (
        index.filter((F.col("start") < start + n) & (F.col("start") + F.col("n") > start))
        .select("part", "file", "start").orderBy("start").collect()  # as many files as the rows reach into
    )
    if not found:
        any_file = index.select("part", "file").head()
        schema = spark.read.parquet(f"{path}/rows/part={any_file.part}/{any_file.file}" if any_file else f"{path}/rows").drop("part").schema
        return spark.createDataFrame([], schema)
    files = [f"{path}/rows/part={row.part}/{row.file}" for row in found]
    return spark.read.parquet(*files).orderBy(order).offset(start - found[0].start).limit(n)
