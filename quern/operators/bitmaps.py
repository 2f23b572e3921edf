"""Sets of whole numbers as bitmaps: rows (word, bits), 64 numbers a word, only words that hold any.

All operations are joins and hash aggregates of built-in bit functions; a set is
spread over the cluster by its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of(numbers: DataFrame, column: str) -> DataFrame:
    """The bitmap of a column of numbers from 0 on; nulls and negative numbers are in no set."""
    c = F.col(column).cast("long")
    rows = numbers.where(c >= 0).select(F.shiftrightunsigned(c, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int")).alias("bit"))
    return rows.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _combined(a: DataFrame, b: DataFrame, how: str, bits: Column) -> DataFrame:
    both = a.select("word", F.col("bits").alias("_a")).join(b.select("word", F.col("bits").alias("_b")), "word", how)
    return both.select("word", bits.alias("bits")).where("bits <> 0")


def _side(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("long"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, "inner", F.col("_a").bitwiseAND(F.col("_b")))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("word").agg(F.bit_xor("bits").alias("bits")).where("bits <> 0")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _combined(a, b, "left", F.col("_a").bitwiseAND(F.bitwise_not(_side("_b"))))


def complement(a: DataFrame, size: int) -> DataFrame:
    """The numbers from 0 to size - 1 that a lacks."""
    words = a.sparkSession.range(-(-size // 64)).select(F.col("id").alias("word"))
    last, rest = size // 64, size % 64
    full = F.when(F.col("word") == last, F.lit((1 << rest) - 1).cast("long")).otherwise(F.lit(-1).cast("long"))
    every = words.select("word", full.alias("bits"))
    return difference(every, a)


def count(a: DataFrame) -> DataFrame:
    """One row: how many numbers the set holds."""
    return a.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("count"))


def numbers(a: DataFrame) -> DataFrame:
    """(number) of the set."""
    rows = a.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    return rows.where("(shiftrightunsigned(bits, k) & 1) = 1").select((F.col("word") * 64 + F.col("k")).alias("number"))
