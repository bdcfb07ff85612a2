"""Bitmaps of fixed size that tell a scan which keys a step before has left, so that rows need not be moved."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a bitmap; a power of two. It is broadcast, and has as many rows at most.
MAP_WORDS = 1 << 18


def _place(keys: list[str]) -> tuple[Column, Column]:
    """Word and bit of a key in the bitmap."""
    at = F.pmod(F.xxhash64(*keys), F.lit(MAP_WORDS * 64))
    return F.floor(at / 64).cast("int"), at.cast("int").bitwiseAND(F.lit(63))


def _bits(marked: DataFrame) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    return marked.groupBy("word").agg(F.bit_or(bit).alias("bits"))


def survivors(groups: DataFrame, keys: list[str]) -> DataFrame:
    """The bitmap (word, bits) of the groups' keys: ``MAP_WORDS`` rows at most, whatever their number."""
    word, bit = _place(keys)
    return _bits(groups.select(word.alias("word"), bit.alias("bit")))


def only_survivors(rows: DataFrame, bitmap: DataFrame, keys: list[str], name: str = "survives") -> DataFrame:
    """``rows`` with a mark of those whose key may be in the bitmap; it is never false for one that is."""
    word, bit = _place(keys)
    placed = rows.withColumns({"_word": word, "_bit": bit})
    joined = placed.join(F.broadcast(bitmap), F.col("_word") == F.col("word"), "left")
    hit = F.call_function("shiftright", F.col("bits"), F.col("_bit")).bitwiseAND(F.lit(1).cast("long")) == 1
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_word", "_bit", "word", "bits")


def hash_bitmap(hashes: DataFrame, name: str) -> np.ndarray:
    """A bitmap of a column of 64-bit hashes for tasks in Python: the words as an array of fixed size."""
    word = F.call_function("shiftright", F.col(name), F.lit(6)).bitwiseAND(F.lit(MAP_WORDS - 1))
    marked = hashes.select(word.cast("int").alias("word"), F.col(name).bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = np.zeros(MAP_WORDS, np.int64)
    for row in _bits(marked).collect():
        words[row["word"]] = row["bits"]
    return words


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (words[(hashes >> 6) & (len(words) - 1)] >> (hashes & 63)) & 1 == 1
