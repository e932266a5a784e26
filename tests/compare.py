"""Run a registered query and its SQL on the same tables and compare rows and column names."""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager
from pathlib import Path

import duckdb
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry_points


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def plans_cut():
    """The plans of all that is checkpointed or written as Parquet meanwhile, streams' batches included."""
    found: list[str] = []
    checkpoint, parquet = DataFrame.checkpoint, DataFrameWriter.parquet

    def cut(self, *args, **kwargs):
        found.append(plan(self))
        return checkpoint(self, *args, **kwargs)

    def write(self, *args, **kwargs):
        found.append(plan(self._df))
        return parquet(self, *args, **kwargs)

    DataFrame.checkpoint, DataFrameWriter.parquet = cut, write
    try:
        yield found
    finally:
        DataFrame.checkpoint, DataFrameWriter.parquet = checkpoint, parquet


def differences(spark, con, directory: str, name: str, plans: list[str] | None = None) -> tuple[int, list]:
    """Number of rows of the query, and what differs; ``plans`` gets the plan of its result."""
    df = entry_points.queries()[name](spark, directory)
    if plans is not None:
        plans.append(plan(df))
    columns = sorted(df.columns)
    got = Counter(tuple(row) for row in df.select(*columns).collect())
    text = entry_points.oracle_sql().get(name)
    if text is None:
        return sum(got.values()), []
    result = con.sql(text)
    if sorted(result.columns) != columns:
        return sum(got.values()), [("columns", columns, sorted(result.columns))]
    order = [result.columns.index(c) for c in columns]
    rows = result.fetchall()
    want = Counter(tuple(row[i] for i in order) for row in rows)
    types = {c: str(t) for c, t in zip(result.columns, result.types)}
    spark_types = dict(df.dtypes)
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
             "boolean": "BOOLEAN", "double": "DOUBLE"}
    bad = [(c, spark_types[c], types[c]) for c in columns if names.get(spark_types[c]) != types[c]]
    return sum(got.values()), bad + list((got - want).items())[:3] + list((want - got).items())[:3]
