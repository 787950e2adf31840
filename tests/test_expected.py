"""Figures measured once on the medium tables, and sums that must agree."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import skyledger as sl
from tests.conftest import dicts, rows

ALL = sl.FilterSpec()


def total(df, column="revenue"):
    return df.agg(F.sum(column)).first()[0]


def test_row_counts(marts):
    assert marts.routes_with_airports.count() == 552
    assert marts.revenue_by_route_class.count() == 3056
    assert marts.monthly_revenue.count() == 414


def test_class_revenue(marts):
    assert [(r["class"], r["revenue"]) for r in dicts(sl.class_revenue(marts, ALL))] == [
        ("E", 1058306884.49),
        ("B", 911413306.54),
        ("P", 898707312.60),
    ]


def test_kpi_totals(marts):
    assert rows(sl.kpi_totals(marts, ALL)) == [
        (2491379164.01, 47216, 2491379164.01 / 47216, 529)
    ]


def test_source_stats(marts):
    assert rows(sl.source_stats(marts)) == [(552, 24, 60000, 24, 1995, 2001)]


@pytest.mark.parametrize(
    ("question", "spec", "count"),
    [
        (sl.top_routes, ALL, 15),
        (sl.monthly_trend, ALL, 83),
        (sl.monthly_by_class, sl.FilterSpec(classes=("E",), year=1998), 12),
        (sl.continent_revenue, ALL, 5),
        (sl.route_efficiency, ALL, 15),
        (sl.airport_revenue, ALL, 22),
        (sl.regional_revenue, sl.FilterSpec(continents=("AFRICA", "ASIA", "EUROPE")), 18),
    ],
)
def test_answer_sizes(marts, question, spec, count):
    assert question(marts, spec).count() == count


@pytest.mark.parametrize("classes", [("E", "P", "B"), ("E",), ("P", "X")])
def test_sums_agree(marts, classes):
    spec = sl.FilterSpec(classes=classes)
    by_class = total(sl.class_revenue(marts, spec))
    assert total(sl.monthly_trend(marts, spec)) == pytest.approx(by_class)
    assert total(sl.monthly_by_class(marts, spec)) == pytest.approx(by_class)

    kpi = sl.kpi_totals(marts, spec).first()
    regions = sl.regional_revenue(marts, spec)
    assert total(regions) == pytest.approx(kpi.total_revenue)
    assert total(sl.continent_revenue(marts, spec)) == pytest.approx(kpi.total_revenue)
    assert total(sl.airport_revenue(marts, spec)) <= kpi.total_revenue
    assert total(regions, "revenue_share") == pytest.approx(1.0)
    assert total(sl.class_revenue_share(marts, spec), "revenue_share") == pytest.approx(1.0)

    every_route = sl.FilterSpec(classes=classes, top_n=100_000)
    assert sl.top_routes(marts, every_route).count() == kpi.active_routes


def test_matrix_is_dense_and_keeps_the_total(marts):
    regions = sl.regional_revenue(marts, ALL)
    cells = sl.region_matrix(regions)
    origins = regions.select("origin_continent").distinct().count()
    destinations = regions.select("dest_continent").distinct().count()
    assert cells.count() == origins * destinations == 30
    assert total(cells) == pytest.approx(total(regions))

