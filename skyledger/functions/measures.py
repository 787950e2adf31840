"""Exact totals and guarded ratios.

Money is added up as decimal, whose sum does not depend on the order in which
partial sums meet, and becomes a double once, where a result leaves the engine.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Widest decimal that is summed in two words, and the bits of the low word. Up to
# 2 ** 43 rows in a group, 8.8 million million, neither word's sum can overflow.
_WORDS_PRECISION = 12
_LOW_BITS = 20


def exact_sum(df: DataFrame, name: str) -> Column:
    """SQL's sum of a column of ``df``, for tables of many rows.

    Spark adds decimals of more than 8 digits as objects. Money of up to 12
    digits is taken as a number of minor units instead, by way of a double, whose
    error stays below a thousandth of a unit and is rounded away. The high and
    the low bits of that number are added apart as longs, and become one decimal
    again once per group. That is exact, and as fast as a sum of doubles. Other
    types get the plain sum.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, T.DecimalType) or kind.precision > _WORDS_PRECISION:
        return F.sum(name)
    minor = f"cast(rint(cast(`{name}` as double) * {10**kind.scale}D) as bigint)"
    high = f"cast(sum(shiftright({minor}, {_LOW_BITS})) as decimal(20,0))"
    low = f"cast(sum({minor} & {(1 << _LOW_BITS) - 1}) as decimal(20,0))"
    digits = kind.precision + 10
    units = f"cast({high} * {1 << _LOW_BITS} + {low} as decimal({digits},0))"
    unit = f"{Decimal(1).scaleb(-kind.scale):f}"
    return F.expr(f"cast({units} * {unit} as decimal({digits},{kind.scale}))")


def total(name: str) -> Column:
    """Sum of a column in which a group of nulls, or of no rows, adds up to 0."""
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def as_double(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in double precision; null where the denominator is 0 or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def mean(column: Column) -> Column:
    """Average of the non-null values as exact sum over count; null if there are none."""
    return ratio(F.sum(column), F.count(column))


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))
