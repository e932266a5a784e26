"""Pages of ordered tables: from an index, by quantiles, and the page of each row."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from compare import plan, plans_cut
from pyspark.sql import functions as F

from spindrift.operators import report
from spindrift.sources import orderindex


def test_a_page_reads_one_file(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10_000).select((F.lit(9_999) - F.col("id")).alias("id"), F.md5(F.col("id").cast("string")).alias("link"))
    orderindex.write_ordered(rows, path, rows_per_file=300)
    orderindex.append_ordered(spark.range(10_000, 10_500).select("id", F.lit("new").alias("link")), path, rows_per_file=300)
    index = orderindex.read_index(spark, path)
    assert index.agg(F.sum("n"), F.max("n")).first()[:] == (10_500, 300) and index.count() > 30
    with plans_cut() as found:
        page = orderindex.rows_at(spark, path, 6_000, 10)
    assert found == []  # nothing is written
    assert len(page.inputFiles()) <= 2 and "Exchange" not in re.sub("TakeOrderedAndProject", "", plan(page))
    assert [r.id for r in page.collect()] == list(range(6_000, 6_010))
    assert [r.id for r in orderindex.rows_at(spark, path, 9_995, 10).collect()] == list(range(9_995, 10_005))
    assert [r.id for r in orderindex.rows_at(spark, path, 10_495, 10).collect()] == list(range(10_495, 10_500))
    beyond = orderindex.rows_at(spark, path, 10_500, 10)
    assert beyond.collect() == [] and beyond.columns == ["id", "link"]
    with pytest.raises(ValueError):
        orderindex.append_ordered(spark.range(5).withColumn("link", F.lit("x")), path)


def test_an_empty_table_has_no_pages(spark, tmp_path):
    path = str(tmp_path / "t")
    orderindex.write_ordered(spark.range(0), path)
    assert orderindex.rows_at(spark, path, 0, 10).collect() == []
    orderindex.append_ordered(spark.range(3), path)
    assert [r.id for r in orderindex.rows_at(spark, path, 1, 10).collect()] == [1, 2]


def test_page_numbers_need_one_shuffle_of_the_rows(spark):
    rows = spark.range(5_000).select((F.col("id") * 3 % 5_000).alias("id"), F.lit("x").alias("link"))
    with plans_cut() as found:
        indexed = report.page_index(rows)
    (written,) = found
    assert written.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in written
    text = plan(indexed)
    assert "Window" not in written + text
    assert [line for line in text.splitlines() if re.search(r"Exchange", line) and "BroadcastExchange" not in line] == []
    assert {r.id: r.page for r in indexed.collect()} == {i: i // 10 + 1 for i in range(5_000)}
    assert report.page_index(rows.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["long", "double", "timestamp", "string"])
def test_deep_pages_of_an_unordered_table(spark, kind, monkeypatch):
    monkeypatch.setattr(report, "NEAR_ROWS", 20)
    monkeypatch.setattr(report, "MARGIN", 0.01)
    start = datetime(2024, 1, 1)
    of = {"long": float, "double": lambda i: i / 7, "timestamp": lambda i: start + timedelta(seconds=i), "string": lambda i: f"{i:05}"}[kind]
    values = [None] * 3 + [of(i) for i in range(3_000)]
    if kind == "long":
        values = [None if v is None else int(v) ** 3 for v in values]
    rows = spark.createDataFrame([(v,) for v in reversed(values)], f"at {kind}").repartition(7)
    with plans_cut() as found:
        for page in (1, 4, 150, 300, 301, 302):
            got = [r["at"] for r in report.page_of(rows, page, order="at").collect()]
            assert got == values[10 * (page - 1) : 10 * page], page
    assert kind == "string" or found == []


def test_deep_pages_of_equal_values(spark, monkeypatch):
    monkeypatch.setattr(report, "NEAR_ROWS", 20)
    rows = spark.range(500).select(F.lit(7).alias("id"))
    assert [r.id for r in report.page_of(rows, 40).collect()] == [7] * 10
    assert report.page_of(rows, 51).collect() == []
