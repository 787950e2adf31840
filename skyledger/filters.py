"""The one filter set that every question is asked with."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.functions.labels import CABINS

ALL_CLASSES = tuple(CABINS)

# Fixed value: how many rows a ranking has unless told otherwise.
TOP_N_DEFAULT = 15


@dataclass(frozen=True)
class FilterSpec:
    """Filters taken literally.

    ``classes`` and ``continents`` are IN lists, so an empty tuple selects no
    row. ``continents=None`` means every continent that is known, which still
    leaves out routes whose origin continent is null. ``year`` applies to the
    monthly questions only, ``top_n`` to the ranked ones.
    """

    classes: tuple[str, ...] = ALL_CLASSES
    continents: tuple[str, ...] | None = None
    year: int | None = None
    top_n: int = TOP_N_DEFAULT

    def __post_init__(self) -> None:
        if self.top_n < 0:
            raise ValueError(f"top_n must not be negative, got {self.top_n}")

    @classmethod
    def from_selection(
        cls,
        cabins: Iterable[str] = (),
        continents: Iterable[str] = (),
        year: int | str | None = "All",
        top_n: int = TOP_N_DEFAULT,
    ) -> FilterSpec:
        """Filters as a person picks them: cabin names, and nothing picked means all."""
        codes = {label: code for code, label in CABINS.items()}
        cabins = tuple(cabins)
        unknown = [label for label in cabins if label not in codes]
        if unknown:
            raise ValueError(f"unknown cabin {unknown}; choose from {list(codes)}")
        return cls(
            classes=tuple(codes[label] for label in cabins) or ALL_CLASSES,
            continents=tuple(continents) or None,
            year=None if year in (None, "All") else int(year),
            top_n=top_n,
        )

    def class_matches(self) -> Column:
        return F.col("class").isin(list(self.classes))

    def continent_matches(self) -> Column:
        origin = F.col("origin_continent")
        if self.continents is None:
            return origin.isNotNull()
        return origin.isin(list(self.continents))

    def year_matches(self) -> Column:
        if self.year is None:
            return F.lit(True)
        return F.col("year") == F.lit(self.year)
