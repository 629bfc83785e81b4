"""Exact rounding of ratios of whole numbers, so that every engine gives the same last digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """A ratio of longs, rounded half away from zero to ``digits`` digits; null for a denominator that is null or 0.

    The quotient is taken in whole numbers, so no binary fraction is rounded a second time.
    """
    den = F.nullif(F.abs(denominator.cast("bigint")), F.lit(0).cast("bigint"))
    num = numerator.cast("bigint") * F.signum(denominator).cast("bigint")
    steps = F.call_function("div", 2 * F.abs(num) * 10**digits + den, 2 * den)
    return F.signum(num) * steps / float(10**digits)


def ratio_sql(numerator: str, denominator: str, digits: int) -> str:
    """The same for a positive denominator as DuckDB SQL."""
    num, den = f"({numerator})::bigint", f"nullif({denominator}, 0)::bigint"
    return f"(sign({num}) * ((2 * abs({num}) * {10**digits} + {den}) // (2 * {den})) / {10**digits}.0::double)"


def whole(value: Column, digits: int) -> Column:
    """A number of at most ``digits`` decimal digits as a long of its last digit's units."""
    return F.round(value * 10**digits).cast("bigint")
