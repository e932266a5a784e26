"""Run a stream over what is there now, and read back what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spindrift.session import run_dir


def run_available(stream: DataFrame, name: str, directory: str | None = None) -> DataFrame:
    """Append the stream's rows to Parquet below the shared folder until its input is used up.

    With the same ``directory`` a later run goes on where the last one stopped.
    """
    spark = stream.sparkSession
    directory = directory or run_dir(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{directory}/progress")
        .option("path", f"{directory}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{directory}/rows")
