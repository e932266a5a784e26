"""A small inverted index and ranked search on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.session import cut_lineage, spread
from spindrift.sources.tables import layouts

# Fixed value: what separates terms.
NOT_A_TERM = r"[^\p{L}\p{N}]+"

INDEX_BUCKETS = 256

# Bytes of text whose terms one task deals out, and whose terms one task counts on average.
DEALT_BYTES = 16 << 20
COUNTED_BYTES = 1 << 20


def postings(documents: DataFrame) -> DataFrame:
    """``term, doc_id, tf``: how often each term occurs in each document.

    Terms are counted per document before the shuffle.
    """
    return _terms(documents).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def _terms(documents: DataFrame) -> DataFrame:
    return _split(spread(documents.select("doc_id", "text")))


def _split(texts: DataFrame) -> DataFrame:
    terms = F.explode(F.split(F.lower("text"), NOT_A_TERM))
    return texts.select("doc_id", terms.alias("term")).filter(F.col("term") != "")


def index_documents(documents: DataFrame, path: str, buckets: int = INDEX_BUCKETS, segment: int = 0, spread_over: int = 8) -> None:
    """A segment of a stored index from the texts; their terms are shuffled once.

    Terms are dealt by bucket, counted where they meet, and written there.  A
    bucket is dealt out over ``spread_over`` shares by document, so that a term
    of every document is not counted by one task.  Large texts take more shares
    and tasks, so that what a task holds does not grow with them; their bytes
    are summed up first.  Each increment of documents is a segment of its own; a
    document lies in one segment.  Writing a segment again replaces it.
    """
    texts, size = _dealt(documents.select("doc_id", "text"))
    tasks = ceil(size / COUNTED_BYTES)
    # Half as many pairs of bucket and share as tasks: few pairs then fall to the same task.
    shares = max(spread_over, ceil(tasks / (2 * buckets)))
    bucket = term_bucket(F.col("term"), buckets)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(shares))
    rows = _split(texts).withColumns({"bucket": bucket, "share": share})
    dealt = rows.repartition(max(tasks, _cores(documents)), "bucket", "share")
    counted = dealt.groupBy("bucket", "share", "term", "doc_id").agg(F.count("*").alias("tf")).drop("share")
    _written(counted, f"{path}/segment={segment}", buckets)


def _dealt(texts: DataFrame) -> tuple[DataFrame, int]:
    """The texts, dealt out anew if there are fewer partitions than cores or one holds too much, and their bytes."""
    held = texts.groupBy(F.spark_partition_id().alias("part")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    found = held.agg(F.count("*").alias("parts"), F.sum("bytes").alias("size"), F.max("bytes").alias("most")).first()
    size, cores = found.size or 0, _cores(texts)
    if found.parts < cores or found.most > DEALT_BYTES:
        texts = texts.repartition(max(cores, ceil(size / DEALT_BYTES)))
    return texts, size


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def merge_segments(spark: SparkSession, path: str, merged: str) -> None:
    """All segments of an index as one, at a new place; readers of the old ones are not disturbed."""
    stored = spark.read.parquet(path)
    for n in layouts(stored):
        rows = stored.filter(F.col("buckets") == n).select("bucket", "term", "doc_id", "tf")
        _written(rows.hint("rebalance", "bucket"), f"{merged}/segment=0", n)


def _written(rows: DataFrame, path: str, buckets: int) -> None:
    (
        rows.withColumn("buckets", F.lit(buckets))
        .sortWithinPartitions("bucket", "term", "doc_id")
        .write.mode("overwrite")
        .partitionBy("buckets", "bucket")
        .parquet(path)
    )


def term_stats(index: DataFrame) -> DataFrame:
    """``term, df``: the number of documents that hold each term."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def search(
    index: DataFrame, n_docs: DataFrame, terms: Sequence[str], k: int = 10
) -> DataFrame:
    """The ``k`` best documents by the sum of ``tf * ln((N + 1) / (df + 1))``; ties by ``doc_id``.

    ``index`` may be fresh postings or a stored index; ``n_docs`` is one row
    ``n``.  Only the postings of the query's terms are read; in a stored index
    that is a few of its folders, whose names tell how many there are.
    """
    wanted = sorted({t.lower() for t in terms})
    hits = index.filter(F.col("term").isin(wanted))
    if counts := layouts(index):
        folders = [(F.col("buckets") == n) & (F.col("bucket") == term_bucket(F.lit(t), n)) for n in counts for t in wanted]
        hits = hits.filter(reduce(or_, folders))
    # Both the document counts and the scores need the hits, which may come from raw texts.
    hits = cut_lineage(hits.select("term", "doc_id", "tf"))
    stats = term_stats(hits)
    weight = F.log((n_docs.select("n").scalar() + 1) / (F.col("df") + 1))
    return (
        hits.join(F.broadcast(stats), "term")  # one row per term of the query
        .groupBy("doc_id")
        .agg(F.round(F.sum(F.col("tf") * weight), 6).alias("score"))
        .orderBy(F.desc("score"), "doc_id")
        .limit(k)
    )


def term_bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Postings partitioned by a hash of the term and sorted by it; the number of buckets is part of the layout."""
    (
        index.withColumns({"buckets": F.lit(buckets), "bucket": term_bucket(F.col("term"), buckets)})
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term", "doc_id")
        .write.mode("errorifexists")
        .partitionBy("buckets", "bucket")
        .parquet(path)
    )
