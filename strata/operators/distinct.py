"""Exact distinct counts of integer keys as mergeable bitmaps.

``COUNT(DISTINCT key) GROUP BY g`` makes Spark shuffle every distinct (g, key) pair, and several of them in one
aggregate make it copy every row once per count (Expand).  Surrogate keys are dense, so here 64 neighbouring keys
share one 64-bit word: a group's set is a number of rows (g, word number, bits), built and merged with
``bit_or``, which is combined map-side in a fixed-width hash table, and counted with ``bit_count``.  A set of keys far
apart costs one word a key, as much as a pair; a dense one 64 times less.  (Spark's own bitmap
aggregates keep 32,768 bits for every group and bucket, too much for the thousands of keys of a usual group.)  Words of different
groups merge again, so months add up to years without another look at the lines.  No row holds more than
one word, so a group that a third of all lines belong to is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, BITS = "_word", "_bits"


def key_words(df: DataFrame, group: Sequence[Column | str], key: str, *also: Column) -> DataFrame:
    """The sets of ``key`` per group: (group..., word number, bits).  A NULL key gives a NULL word.
    ``also``: aggregates that add up, taken per group and word in the same pass."""
    number = F.shiftright(F.col(key).cast("long"), 6).alias(WORD)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).cast("long").bitwiseAND(F.lit(63)).cast("int"))
    return df.groupBy(*group, number).agg(F.bit_or(bit).alias(BITS), *also)


def merge_words(words: DataFrame, group: Sequence[Column | str], *also: Column) -> DataFrame:
    """Sets of coarser groups, as unions of finer ones."""
    return words.groupBy(*group, WORD).agg(F.bit_or(BITS).alias(BITS), *also)


def count_words(words: DataFrame, group: Sequence[Column | str], out: str, *also: Column) -> DataFrame:
    """The number of keys in each group's set (0 if it saw only NULL)."""
    return words.groupBy(*group).agg(F.coalesce(F.sum(F.bit_count(BITS)), F.lit(0)).cast("long").alias(out), *also)


def distinct_keys(df: DataFrame, group: Sequence[Column | str], key: str, out: str) -> DataFrame:
    """``COUNT(DISTINCT key) AS out`` per group."""
    words = key_words(df, group, key)
    return count_words(words, words.columns[: len(group)], out)
