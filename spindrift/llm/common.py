"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.session import run_dir
from spindrift.sources.tables import table_path

LAST_DOC = (1 << 63) - 1


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(directory, name))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows as a table in the shared folder, so that later steps neither compute nor shuffle them again.

    The shuffle files behind the write go as soon as it is done; ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def identified(docs: DataFrame) -> DataFrame:
    """Rows with a unique (doc, tie) in the order of their ids, null ones last; a copy is kept where ids are not unique."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC))
    twice = docs.groupBy(doc.alias("doc")).count().filter("count > 1").limit(1).count()
    if not twice:
        return docs.withColumn("doc", doc).withColumn("tie", F.lit(0).cast("long"))
    return written(docs.withColumn("doc", doc).withColumn("tie", F.monotonically_increasing_id()), "identified")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def tidy(run: Callable) -> Callable:
    """The same function over batches or a group; its worker process, which goes on to other tasks, gives memory back."""

    @functools.wraps(run)
    def wrapped(given):
        out = run(given)
        if isinstance(out, Iterator):
            return drained(out)
        release()
        return out

    return wrapped


def drained(batches: Iterator) -> Iterator:
    yield from batches
    release()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null as no bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of one column; one longer value stays whole."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
