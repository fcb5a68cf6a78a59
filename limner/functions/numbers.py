"""Rounding and number formatting that decide ties on the exact binary value.

``round`` works on the shortest decimal text of a double and so lifts 2.675 to
2.68, although the stored value lies below the tie. ``format_number`` looks at
the stored value, which is what the published metrics were rounded with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int, grouping: bool = False) -> Column:
    """Text with a fixed number of decimals, with ``,`` between thousands if asked."""
    text = F.format_number(x, digits)
    return text if grouping else F.replace(text, F.lit(","), F.lit(""))


def percent(x: Column, digits: int = 2) -> Column:
    """``0.1234`` as ``12.34%``."""
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def round_exact(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals on the exact binary value.

    Away from a tie plain arithmetic gives the same double; only values within
    a hair of a tie, or too large for it, are written out and read back.
    """
    x = x.cast("double")
    scaled = x * F.lit(float(10**digits))
    near_tie = F.abs(scaled - F.floor(scaled) - 0.5) < 1e-5
    plain = F.rint(scaled) / F.lit(float(10**digits))
    return F.when(F.isnan(x) | (F.abs(scaled) > 1e9) | near_tie, fixed(x, digits).cast("double")).otherwise(plain)


def clamp(x: Column, lo: int | float, hi: int | float) -> Column:
    """Limit to ``[lo, hi]``."""
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
