"""Scalar functions on numbers, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """A double rounded half away from zero as SQL engines on binary doubles do it: scaled, rounded to a whole number and
    scaled back.  Spark's own round goes by the decimal digits that a double prints as, and takes other sides of ties."""
    scale = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale


def plain_number(c: Column) -> Column:
    """A finite double as JSON writes it, without an exponent between 1e-6 and 1e21."""
    text, size = c.cast("string"), F.abs(c)
    digits = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,15)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when((size >= 1e-6) & (size < 1e-3) | (size >= 1e7) & (size < 1e21), digits).otherwise(text)
