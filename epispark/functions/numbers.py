"""Exact rounding and number formatting as Column builders.

Rates are built from integer counts so that rounding is exact and the
same in every engine: ``round_ratio(n, d, scale, digits)`` is
``n * 10**scale / d`` rounded half away from zero to ``digits`` places.
Text with one decimal is built from the integer number of tenths, never
from a float format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# A plain or exponent number; a cast alone would also take suffixes ("12d").
NUMBER_SHAPE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_number(col) -> Column:
    """Numeric text as a double, anything else NULL; other types are cast."""
    c = F.col(col) if isinstance(col, str) else col
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def round_ratio(num, den, scale: int = 2, digits: int = 2, zero=0.0) -> Column:
    """``num/den * 10**scale`` rounded half away from zero; ``zero`` when den is 0."""
    num, den = _c(num), _c(den)
    mult = 10 ** (scale + digits)
    mag = F.floor((F.abs(num) * (2 * mult) + den) / (den * 2))
    signed = F.when(num < 0, -mag).otherwise(mag)
    value = signed / float(10 ** digits)
    return F.when(den > 0, value).otherwise(F.lit(zero).cast("double"))


def ratio_units(num, den, scale: int = 2, digits: int = 1) -> Column:
    """Integer count of ``10**-digits`` units of ``|num|/den*10**scale`` (half-up)."""
    num, den = _c(num), _c(den)
    mult = 10 ** (scale + digits)
    return F.when(den > 0, F.floor((F.abs(num) * (2 * mult) + den) / (den * 2))).otherwise(F.lit(0).cast("bigint"))


def tenths_text(units) -> Column:
    """'12.3' from 123 (non-negative integer tenths)."""
    units = _c(units)
    return F.concat((units / 10).cast("bigint").cast("string"), F.lit("."), (units % 10).cast("string"))


def hundredths_text(units) -> Column:
    """'12.34' from 1234 (non-negative integer hundredths)."""
    units = _c(units)
    frac = units % 100
    return F.concat(
        (units / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.when(frac < 10, F.concat(F.lit("0"), frac.cast("string"))).otherwise(frac.cast("string")),
    )


def round_double(x, digits: int) -> Column:
    """Half-up rounding of a double through ``floor(x*10^d + 0.5)``."""
    x = _c(x)
    p = float(10 ** digits)
    return F.floor(x * p + 0.5) / p


def number_text(x) -> Column:
    """Python-style ``str(float)`` for values with at most two decimals
    (``12.5`` -> '12.5', ``12.0`` -> '12.0', ``-3.25`` -> '-3.25')."""
    x = _c(x)
    cents = F.floor(F.abs(x) * 100 + 0.5).cast("bigint")
    whole = (cents / 100).cast("bigint").cast("string")
    frac = cents % 100
    frac_text = (
        F.when(frac == 0, F.lit("0"))
        .when(frac % 10 == 0, (frac / 10).cast("bigint").cast("string"))
        .when(frac < 10, F.concat(F.lit("0"), frac.cast("string")))
        .otherwise(frac.cast("string"))
    )
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.lit("."), frac_text)
