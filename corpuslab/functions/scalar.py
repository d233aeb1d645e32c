"""Scalar expressions for feature work."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def parse_time(col: Column) -> Column:
    """Timestamp from text; text that cannot be read becomes NULL."""
    return F.try_to_timestamp(col)


def day_of_week(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def sunday_first(dow: Column) -> Column:
    """Monday = 0 to Sunday = 0."""
    return (dow + 1) % 7


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of the value's place on a circle."""
    angle = value * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def safe_ratio(a: Column, b: Column) -> Column:
    return a / (b + 1)


def rescale(values: Column, top: float = 255.0) -> Column:
    """Each array element divided by ``top``."""
    return F.transform(values, lambda x: x / F.lit(top))


def rounded(col: Column, digits: int = 6) -> Column:
    """Round for output; adding zero turns -0.0 into 0.0."""
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def draw_order(key: str, seed: int) -> Column:
    """A random number per key, the same in every run: 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
