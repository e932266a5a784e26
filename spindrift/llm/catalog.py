"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.alignment import alignment_report
from spindrift.llm.common import table
from spindrift.llm.fmindex import contamination
from spindrift.llm.hmm import score_documents
from spindrift.llm.langid import language_report
from spindrift.llm.ngramjoin import ngram_components
from spindrift.llm.oracle import ORACLE
from spindrift.llm.packing import pack_documents
from spindrift.llm.prefixes import prefix_trie
from spindrift.llm.quality import quality_report
from spindrift.llm.repeats import repeat_report
from spindrift.llm.shards import shard_by_bytes
from spindrift.llm.simhash import duplicates_report
from spindrift.llm.vptree import neighbours
from spindrift.llm.warc import archived_pages

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_best_fit_packing(spark, directory):
    return pack_documents(table(spark, directory, "documents"))


@query
def op2_warc(spark, directory):
    return archived_pages(table(spark, directory, "pages"), version=1, min_bytes=0)


@query
def op3_minimax_shards(spark, directory):
    return shard_by_bytes(table(spark, directory, "documents"), 16)


@query
def op4_vantage_point_trees(spark, directory):
    rows = table(spark, directory, "embeddings")
    return neighbours(rows, F.col("vec_id") % 20 == 0)


@query
def op5_fm_index_decontamination(spark, directory):
    return contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query
def op9_simhash_multi_index(spark, directory):
    return duplicates_report(table(spark, directory, "documents"))


@query
def op7_string_kernel_language(spark, directory):
    return language_report(table(spark, directory, "documents"))


@query
def op8_neighbour_vote_quality(spark, directory):
    return quality_report(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query
def op10_hidden_markov_scores(spark, directory):
    return score_documents(table(spark, directory, "documents"))


@query
def op6_suffix_dedup(spark, directory):
    return repeat_report(table(spark, directory, "documents"))


@query
def op11_conversation_prefixes(spark, directory):
    return prefix_trie(table(spark, directory, "conversations"))


@query
def op12_token_alignment(spark, directory):
    return alignment_report(table(spark, directory, "documents"))


@query
def op13_ngram_jaccard(spark, directory):
    return ngram_components(table(spark, directory, "documents"))
