"""Values scaled to [0, 1]: what value-ordered access paths place them by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The share of the first byte and of the length in a text's place, and the longest text that counts.
FIRST_BYTE, LENGTH, MOST_BYTES = 0.7, 0.3, 1024
# The span of times, in milliseconds.
TIMES = (0, 4_102_444_800_000)


def number(value: Column, low: float, high: float) -> Column:
    """Linear between low and high, held inside; 0.5 where they are one, 0 for what is no number."""
    if low == high:
        return F.when(value.isNotNull(), 0.5)
    x = value.cast("double")
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def time(value: Column, low: int = TIMES[0], high: int = TIMES[1]) -> Column:
    """Of milliseconds since 1970."""
    return number(value, low, high)


def text(value: Column, most: int = MOST_BYTES) -> Column:
    """By its first byte, then its length: not in the order of texts."""
    data = value.cast("binary")
    first = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("double") / 255.0
    return F.when(F.octet_length(data) == 0, 0.0).otherwise(F.least(first * FIRST_BYTE + F.least(F.octet_length(data) / most, F.lit(1.0)) * LENGTH, F.lit(1.0)))


def digest(value: Column) -> Column:
    """Of bytes: the first eight as a share of the greatest such number; 0 for fewer."""
    high = F.conv(F.hex(F.substring(value, 1, 8)), 16, 10).cast("decimal(20,0)").cast("double")
    return F.when(F.octet_length(value) < 8, 0.0).otherwise(high / float((1 << 64) - 1))
