"""Human-readable labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cabin class codes and their names.
CABINS = {"E": "Economy", "P": "Premium", "B": "Business"}

# What stands between two ends, and for an end that is not known.
ARROW = " → "
UNKNOWN_CITY = "?"
UNKNOWN_REGION = "Unknown"

# Unit suffixes of a compact amount, largest first.
MONEY_UNITS = ((1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K"))


def cabin_label(code: Column) -> Column:
    """Cabin name of a class code; a code without a name stands for itself."""
    names = F.create_map(*[F.lit(part) for pair in CABINS.items() for part in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def route_label(route_code: Column, origin_city: Column, dest_city: Column) -> Column:
    return F.concat(
        F.coalesce(origin_city, route_code),
        F.lit(ARROW),
        F.coalesce(dest_city, F.lit(UNKNOWN_CITY)),
    )


def region_label(origin_continent: Column, dest_continent: Column) -> Column:
    unknown = F.lit(UNKNOWN_REGION)
    return F.concat(
        F.coalesce(origin_continent, unknown),
        F.lit(ARROW),
        F.coalesce(dest_continent, unknown),
    )


def compact_money(amount: Column) -> Column:
    """Short dollar amount such as ``$1.2B``; the unit goes by absolute value.

    ``format_number`` with a pattern rounds the exact binary value half to even.
    """
    amount = amount.cast("double")

    def shown(value: Column, pattern: str) -> Column:
        return F.call_function("format_number", value, F.lit(pattern))

    text = shown(amount, "#,##0")
    for unit, suffix in reversed(MONEY_UNITS):
        scaled = F.concat(shown(amount / F.lit(float(unit)), "0.0"), F.lit(suffix))
        text = F.when(F.abs(amount) >= F.lit(unit), scaled).otherwise(text)
    return F.concat(F.lit("$"), text)
