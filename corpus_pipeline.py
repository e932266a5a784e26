"""From raw documents to packed training sequences: five stages, each a table for the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.  Rejected documents go, one document of
each group whose SimHash fingerprints link stays, repeated strings and benchmark
passages are cut out of the texts, and what is left is packed into sequences.
A text that is cut down to nothing stays as an empty document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.common import table, written
from spindrift.llm.fmindex import decontaminate
from spindrift.llm.packing import pack_documents
from spindrift.llm.quality import keep_good
from spindrift.llm.repeats import cut_repeats
from spindrift.llm.simhash import EXACT, one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints: three-word shingles, three differing bits at most."""
    return one_of_each(docs, EXACT)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

# No stage but the first reading of the tables can be put into SQL: the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
