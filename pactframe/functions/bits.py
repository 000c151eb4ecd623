"""Sets of numbers as bits: marks of rows by their place, and filters of keys by their hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Numbers that share a row of bits; what bitmap_construct_agg takes.
RUN_BITS = 15

# Bits of a filter for each key, and the most of all (32 MB); a fuller filter lets more other keys pass.
BITS_PER_KEY, MOST_BITS = 16, 28


def run_of(number: str) -> Column:
    return F.shiftright(F.col(number), RUN_BITS)


def bit_rows(numbers: DataFrame, number: str, *by: str) -> DataFrame:
    """(by..., _run, _words): the numbers as rows of 512 longs, one for each 32,768 that hold any."""
    runs = numbers.select(*by, run_of(number).alias("_run"), F.col(number).bitwiseAND((1 << RUN_BITS) - 1).alias("_bit"))
    found = runs.groupBy(*by, "_run").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    words = F.expr("transform(sequence(0, 511), i -> cast(conv(hex(substring(_bits, i * 8 + 1, 8)), 16, -10) as bigint))")
    return found.select(*by, "_run", words.alias("_words"))


def holds(words: str, number: str) -> Column:
    """Whether the number is in the row of bits of its run; never NULL.

    Words are read from the left and the bits of their bytes from the right.
    """
    word = f"get({words}, cast(shiftright({number} & {(1 << RUN_BITS) - 1}, 6) as int))"
    return F.coalesce(F.expr(f"shiftright({word}, cast(({number} & 63) ^ 56 as int)) & 1") == 1, F.lit(False))


def key_bits(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """The bits of the hashes of the keys, all columns of ``keys``, and the mask of these hashes."""
    mask = (1 << min(max((count * BITS_PER_KEY).bit_length(), RUN_BITS), MOST_BITS)) - 1
    return bit_rows(keys.select(F.xxhash64(*keys.columns).bitwiseAND(mask).alias("_hash")), "_hash"), mask


def may_match(rows: DataFrame, columns: list[Column], bits: DataFrame, mask: int) -> DataFrame:
    """The rows whose key has a bit: all that have one of the keys, and a few others.

    The columns must have the types of the keys.  At most 32 MB are broadcast,
    and no row is shuffled.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*columns).bitwiseAND(mask)).withColumn("_run", run_of("_hash"))
    return hashed.join(F.broadcast(bits), "_run").where(holds("_words", "_hash")).select(*rows.columns)
