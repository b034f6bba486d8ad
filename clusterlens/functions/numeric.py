"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

#: Texts that read as a floating-point number (no type suffixes such as ``1.5d``).
FLOAT_PATTERN = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def signif(c, digits: int = 7) -> Column:
    """Round to ``digits`` significant digits, ties to even; 0 stays 0.

    Ten-digit epoch seconds with 7 digits land on a 1000 s grid. The result
    is DOUBLE; cast it back for integer inputs.
    """
    x = as_col(c).cast("double")
    e = F.floor(F.log10(F.abs(x))) - (digits - 1)
    up = F.rint(x / F.pow(F.lit(10.0), e)) * F.pow(F.lit(10.0), e)
    down = F.rint(x * F.pow(F.lit(10.0), -e)) / F.pow(F.lit(10.0), -e)
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(x == 0, F.lit(0.0))
            .when(e >= 0, up)
            .otherwise(down))


def null_sentinel(c, sentinel=-1) -> Column:
    """A sentinel value (default -1) becomes NULL."""
    return F.nullif(as_col(c), F.lit(sentinel))


def safe_div(num, den) -> Column:
    """Division that yields NULL for a zero or NULL denominator (ANSI-safe)."""
    return as_col(num) / F.nullif(as_col(den), F.lit(0))
