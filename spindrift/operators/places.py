"""Late materialisation: choose rows by narrow columns, then read the wide ones of the chosen rows.

A row that comes from a file has a place, its file and its number there.  What
is chosen among such rows is chosen without their texts, and only texts at
chosen places are joined, sorted or shuffled.

A ``sieve`` keeps rows whose key may be among others: a Bloom filter in words of
64 bits, built by one aggregation and sent to every task.  It has a row for
each word that is used, ``SIEVE_WORDS`` of them at most, whatever the number of
keys.  It lets a few others through, so an exact join follows it; with far more
keys than words it lets most rows through, which costs time only.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.dims import FEW_ROWS
from spindrift.session import run_dir

PLACE = ["_file", "_row"]

# Words of 64 bits that are sent at most; with 16 bits for each key this serves 16 million keys.
SIEVE_WORDS = 1 << 22
BITS_PER_KEY, BITS_SET = 16, 4

# Nodes that neither lose a row's place nor give it to several rows.
KEEP_PLACES = re.compile(r"^[\s:+\-]*(Project|Filter|SubqueryAlias|View|Relation|LogicalRelation|ResolvedHint|Repartition)\b")


def has_places(df: DataFrame) -> bool:
    """Whether each row is one row of a file, so far as the plan tells."""
    plan = df._jdf.queryExecution().analyzed().treeString().strip().splitlines()
    if not all(KEEP_PLACES.match(line) for line in plan):
        return False
    try:
        return bool(from_files(df))
    except AnalysisException:  # rows of other sources, or of files that do not number them
        return False


def from_files(df: DataFrame) -> DataFrame:
    """Rows read from Parquet, with their places."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as they come, with their places."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return from_files(df.sparkSession.read.schema(df.schema).parquet(path))


def with_places(df: DataFrame, name: str) -> DataFrame:
    """The rows with their places; written first if they do not come from files as they are."""
    if set(PLACE) <= set(df.columns):
        return df
    return from_files(df) if has_places(df) else stored(df, name)


def at_places(rows: DataFrame, chosen: DataFrame, few: bool | None = None) -> DataFrame:
    """The rows at chosen places, with the other columns of ``chosen``.

    Few places are sent to the rows.  Else the rows are sieved before they are
    shuffled, so that texts at other places stay where they are.
    """
    if few is None:
        few = chosen.count() <= FEW_ROWS
    if few:
        return rows.join(F.broadcast(chosen), PLACE)
    return sieved(rows, chosen, PLACE).join(chosen, PLACE)


def words_for(keys: int) -> int:
    """Words for so many keys: a power of two up to ``SIEVE_WORDS``."""
    return min(SIEVE_WORDS, 1 << max(4, (max(1, keys) * BITS_PER_KEY // 64).bit_length()))


def _word_and_mask(columns: list[str], words: int) -> tuple[Column, Column]:
    hashed = F.xxhash64(*columns)
    bits = F.xxhash64(hashed, F.lit(1))
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for i in range(BITS_SET):
        place = F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, place))
    return F.pmod(hashed, F.lit(words)), mask


def sieve(keys: DataFrame, columns: list[str], words: int) -> DataFrame:
    """(_word, _bits) of the keys, a row for each word that is used."""
    word, mask = _word_and_mask(columns, words)
    return keys.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))


def sieved(rows: DataFrame, keys: DataFrame, columns: list[str], count: int | None = None) -> DataFrame:
    """The rows whose key may be among the keys: all that are, and few others."""
    words = words_for(keys.count() if count is None else count)
    word, mask = _word_and_mask(columns, words)
    kept = rows.withColumn("_word", word).join(F.broadcast(sieve(keys, columns, words)), "_word")
    return kept.filter(F.col("_bits").bitwiseAND(mask) == mask).drop("_word", "_bits")
