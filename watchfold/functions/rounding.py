"""Decimal rounding of doubles by their exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_exact(c: Column, digits: int) -> Column:
    """round(c * 10^digits) as bigint for c >= 0, judged on the exact value of the double.

    The double is split into two halves of at most 26 bits, so both partial products are exact
    and the sign of the distance to the midpoint is exact as well.
    """
    scale = float(10 ** digits)
    big = c * F.lit(134217729.0)
    hi = big - (big - c)
    lo = c - hi
    down = F.floor(c * scale)
    rest = (hi * scale - (down + F.lit(0.5))) + lo * scale
    return (F.when(rest > 0, down + 1).when(rest < 0, down)
            .otherwise(down + F.pmod(down, F.lit(2)))).cast("bigint")


def round_exact(c: Column, digits: int) -> Column:
    sign = F.when(c < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * scaled_exact(F.abs(c), digits) / F.lit(float(10 ** digits))


def fixed_text(c: Column, digits: int) -> Column:
    """c >= 0 with exactly ``digits`` decimals."""
    units = scaled_exact(c, digits).cast("string")
    padded = F.lpad(units, F.greatest(F.length(units), F.lit(digits + 1)), F.lit("0"))
    cut = F.length(padded) - digits
    return F.concat(padded.substr(F.lit(1), cut), F.lit("."), padded.substr(cut + 1, F.lit(digits)))


def plain_text(c: Column, digits: int = 4) -> Column:
    """Shortest decimal text of a value rounded to ``digits``, with at least one decimal."""
    fixed = c.cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(fixed, f"0{{1,{digits - 1}}}$", "")
