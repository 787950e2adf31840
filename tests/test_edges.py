"""Semantics on hand-written rows: nulls, ties, zeros, orphans, unknown codes."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import skyledger as sl
from tests.conftest import AIRPORT_ROWS, dicts, rows

ALL = sl.FilterSpec()


def by(df, key):
    return {row[key]: row for row in dicts(df)}


# Sums over nothing


def test_group_without_amounts_is_null_in_marts_and_zero_in_answers(edge):
    marts = edge([("AB", "E", None), ("AB", "E", None)])
    mart = dicts(marts.revenue_by_route_class)[0]
    assert (mart["ticket_count"], mart["revenue"], mart["avg_ticket_value"]) == (2, None, None)
    assert dicts(sl.top_routes(marts, ALL))[0]["revenue"] == 0.0
    assert dicts(sl.class_revenue(marts, ALL))[0]["revenue"] == 0.0
    assert dicts(sl.monthly_trend(marts, ALL))[0]["revenue"] == 0.0
    assert dicts(sl.continent_revenue(marts, ALL))[0]["revenue"] == 0.0
    assert dicts(sl.airport_revenue(marts, ALL))[0]["revenue"] == 0.0
    assert dicts(sl.regional_revenue(marts, ALL))[0]["revenue"] == 0.0


def test_month_by_class_passes_a_null_revenue_through(edge):
    row = dicts(sl.monthly_by_class(edge([("AB", "E", None)]), ALL))[0]
    assert (row["ticket_count"], row["revenue"], row["cabin_class"]) == (1, None, "Economy")


def test_mart_average_skips_null_amounts_but_the_count_does_not(edge):
    marts = edge([("AB", "E", 10), ("AB", "E", 20), ("AB", "E", None)])
    mart = dicts(marts.revenue_by_route_class)[0]
    assert (mart["ticket_count"], mart["avg_ticket_value"]) == (3, 15.0)
    assert dicts(sl.top_routes(marts, ALL))[0]["avg_ticket_value"] == 10.0


def test_mart_keeps_null_keys_as_groups(edge):
    marts = edge([(None, None, 1), (None, None, 2), (None, "E", 4), ("AB", None, 8)])
    found = {(r["route_code"], r["class"]): r["ticket_count"] for r in dicts(marts.revenue_by_route_class)}
    assert found == {(None, None): 2, (None, "E"): 1, ("AB", None): 1}


def test_taxes_are_summed_per_group(edge):
    mart = dicts(edge([("AB", "E", 1), ("AB", "E", 2)]).revenue_by_route_class)[0]
    assert (float(mart["total_airport_tax"]), float(mart["total_local_tax"])) == (2.0, 4.0)


# Orphans and unknown codes


def test_route_without_airports_counts_in_classes_and_months_only(edge):
    marts = edge([("AB", "E", 1), ("ZZ", "E", 100)])
    assert dicts(sl.class_revenue(marts, ALL))[0]["revenue"] == 101.0
    assert dicts(sl.monthly_trend(marts, ALL))[0]["revenue"] == 101.0
    assert dicts(sl.monthly_by_class(marts, ALL))[0]["revenue"] == 101.0
    assert [r["route_code"] for r in dicts(sl.top_routes(marts, ALL))] == ["AB"]
    assert dicts(sl.kpi_totals(marts, ALL))[0]["total_revenue"] == 1.0
    assert dicts(sl.continent_revenue(marts, ALL))[0]["revenue"] == 1.0
    assert dicts(sl.regional_revenue(marts, ALL))[0]["revenue"] == 1.0


def test_route_with_one_unknown_airport_is_not_in_the_network(edge):
    marts = edge([], routes=[("AB", "AAA", "BBB"), ("AX", "AAA", "XXX"), ("XA", "XXX", "AAA")])
    assert [r["route_code"] for r in dicts(marts.routes_with_airports)] == ["AB"]


def test_unknown_and_null_classes_are_left_out_unless_asked_for(edge):
    marts = edge([("AB", "X", 1), ("AB", None, 2), ("AB", "E", 4)])
    assert [r["class"] for r in dicts(sl.class_revenue(marts, ALL))] == ["E"]
    asked = dicts(sl.class_revenue(marts, sl.FilterSpec(classes=("X",))))
    assert [(r["class"], r["cabin_class"], r["revenue"]) for r in asked] == [("X", "X", 1.0)]
    assert dicts(sl.monthly_by_class(marts, sl.FilterSpec(classes=("X",))))[0]["cabin_class"] == "X"


def test_null_origin_continent_never_passes_but_counts_in_classes(edge):
    marts = edge([("CA", "E", 5), ("AB", "E", 1)])
    assert dicts(sl.kpi_totals(marts, ALL))[0]["total_revenue"] == 1.0
    assert [r["origin_continent"] for r in dicts(sl.continent_revenue(marts, ALL))] == ["ASIA"]
    assert dicts(sl.class_revenue(marts, ALL))[0]["revenue"] == 6.0


def test_null_destination_continent_is_a_region_of_its_own(edge):
    found = by(sl.regional_revenue(edge([("AC", "E", 3), ("AB", "E", 1)]), ALL), "region_pair")
    assert set(found) == {"ASIA → Unknown", "ASIA → EUROPE"}
    assert found["ASIA → Unknown"]["dest_continent"] is None


def test_missing_cities_fall_back_in_labels(edge):
    found = by(sl.top_routes(edge([("DB", "E", 1), ("BD", "E", 2)]), ALL), "route_code")
    assert found["DB"]["route_label"] == "DB → Bville"
    assert found["BD"]["route_label"] == "Bville → ?"


# Ties, limits, distances


def test_ties_at_the_cut_go_by_route_code(edge):
    marts = edge([("BD", "E", 7), ("AB", "E", 7), ("BA", "E", 7), ("AC", "E", 9)])
    ranked = [r["route_code"] for r in dicts(sl.top_routes(marts, sl.FilterSpec(top_n=3)))]
    assert ranked == ["AC", "AB", "BA"]


def test_ranking_compares_exact_amounts(edge):
    """Two totals that are one double apart at most still rank by the cent."""
    big = 9_999_999_999.99
    tickets = [(code, "E", big) for code in ("AB", "BA") for _ in range(2000)]
    marts = edge([*tickets, ("BA", "E", 0.01)])
    assert [r["route_code"] for r in dicts(sl.top_routes(marts, ALL))] == ["BA", "AB"]


def test_efficiency_leaves_out_zero_and_unknown_distances(edge):
    marts = edge([("AC", "E", 50), ("DB", "E", 50), ("AB", "E", 50), ("BD", "E", 50)])
    found = rows(sl.route_efficiency(marts, ALL).select("route_code", "revenue_per_km"))
    assert found == [("BD", 0.5), ("AB", 0.05)]


def test_mean_distance_counts_zero_and_skips_null(edge):
    marts = edge(
        [("R1", "E", 1), ("R2", "E", 1), ("R3", "E", 1)],
        routes=[("R1", "AAA", "BBB", 100), ("R2", "AAA", "BBB", 0), ("R3", "AAA", "BBB", None)],
    )
    row = dicts(sl.regional_revenue(marts, ALL))[0]
    assert (row["route_count"], row["avg_distance"]) == (3, 50.0)


def test_mean_distance_of_unknown_distances_is_null(edge):
    row = dicts(sl.regional_revenue(edge([("DB", "E", 1)]), ALL))[0]
    assert row["avg_distance"] is None


# Zero totals


def test_share_of_a_zero_total_is_null(edge):
    marts = edge([("AB", "E", 5), ("BA", "E", -5)])
    assert [r["revenue_share"] for r in dicts(sl.regional_revenue(marts, ALL))] == [None, None]
    assert dicts(sl.class_revenue_share(marts, ALL))[0]["revenue_share"] is None


@pytest.mark.parametrize(
    "spec",
    [
        sl.FilterSpec(classes=()),
        sl.FilterSpec(continents=()),
        sl.FilterSpec(continents=("ATLANTIS",)),
    ],
)
def test_filters_that_leave_nothing(edge, spec):
    marts = edge([("AB", "E", 5)])
    assert rows(sl.kpi_totals(marts, spec)) == [(0.0, 0, 0.0, 0)]
    assert rows(sl.top_routes(marts, spec)) == []
    assert rows(sl.airport_revenue(marts, spec)) == []
    regions = sl.regional_revenue(marts, spec)
    assert rows(regions) == []
    assert rows(sl.region_matrix(regions)) == []


def test_empty_class_list_is_taken_literally(edge):
    marts, nothing = edge([("AB", "E", 5)]), sl.FilterSpec(classes=())
    for question in (sl.class_revenue, sl.monthly_trend, sl.monthly_by_class, sl.continent_revenue):
        assert rows(question(marts, nothing)) == []


def test_zero_top_n(edge):
    assert rows(sl.top_routes(edge([("AB", "E", 5)]), sl.FilterSpec(top_n=0))) == []


# Time


def test_null_departure_makes_a_month_without_a_date(edge):
    marts = edge([("AB", "E", 1, None), ("AB", "E", 2, datetime(2021, 3, 31, 23, 59))])
    assert rows(sl.monthly_trend(marts, ALL)) == [
        (None, None, 1.0, 1, None),
        (2021, 3, 2.0, 1, date(2021, 3, 1)),
    ]
    assert rows(sl.list_years(marts)) == [(None,), (2021,)]


def test_year_filter_is_an_equality_and_all_means_none(edge):
    marts = edge([("AB", "E", 1, datetime(y, 1, 1)) for y in (2019, 2020, 2020)])
    assert rows(sl.monthly_trend(marts, sl.FilterSpec(year=2020)).select("year", "revenue")) == [
        (2020, 2.0)
    ]
    assert sl.monthly_by_class(marts, ALL).count() == 2


def test_tickets_of_a_year_are_whole(star):
    moments = [
        datetime(2019, 12, 31, 23, 59, 59, 999999),
        datetime(2020, 1, 1),
        datetime(2020, 12, 31, 23, 59, 59, 999999),
        datetime(2021, 1, 1),
        None,
    ]
    kept = star([("AB", "E", 1, m) for m in moments]).of_year(2020).tickets
    assert sorted(r.departure for r in kept.collect()) == moments[1:3]


def test_continent_and_year_filters_stay_where_they_belong(edge):
    marts = edge([("AB", "E", 1, datetime(2019, 1, 1)), ("BA", "E", 2, datetime(2020, 1, 1))])
    narrow = sl.FilterSpec(continents=("ASIA",), year=2019)
    assert dicts(sl.class_revenue(marts, narrow))[0]["revenue"] == 3.0
    assert sl.continent_revenue(marts, narrow).count() == 2
    assert dicts(sl.monthly_trend(marts, narrow))[0]["revenue"] == 1.0
    assert dicts(sl.kpi_totals(marts, narrow))[0]["total_revenue"] == 1.0


def test_timestamps_do_not_move_with_the_session_time_zone(spark, edge):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        marts = edge([("AB", "E", 1, datetime(2020, 12, 31, 23, 30))])
        assert rows(marts.monthly_revenue.select("year", "month")) == [(2020, 12)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# Places


def test_airports_without_coordinates_are_left_out(edge):
    airports = [*AIRPORT_ROWS[:2], ("EEE", "Eville", "ASIA", None, 20), ("FFF", "F", "ASIA", 1, None)]
    routes = [("AB", "AAA", "BBB"), ("EB", "EEE", "BBB"), ("FB", "FFF", "BBB")]
    marts = edge([("AB", "E", 1), ("EB", "E", 2), ("FB", "E", 3)], routes, airports)
    assert [r["origin"] for r in dicts(sl.airport_revenue(marts, ALL))] == ["AAA"]
    assert dicts(sl.kpi_totals(marts, ALL))[0]["total_revenue"] == 6.0


def test_airport_revenue_belongs_to_the_departure(edge):
    found = by(sl.airport_revenue(edge([("AB", "E", 1), ("AC", "P", 2), ("BA", "E", 4)]), ALL), "origin")
    assert {code: row["revenue"] for code, row in found.items()} == {"AAA": 3.0, "BBB": 4.0}
    assert found["AAA"]["origin_airport"] == "AAA Intl"
    assert (found["AAA"]["origin_lat"], found["AAA"]["origin_lon"]) == (10.0, 20.0)


def test_catalog_lists(edge):
    marts = edge([("AB", "E", 1), ("ZZ", "X", 1, datetime(2018, 5, 1))])
    assert rows(sl.list_continents(marts)) == [("ASIA",), ("EUROPE",)]
    assert rows(sl.list_years(marts)) == [(2018,), (2020,)]
    # four origins and destinations in use, but origin countries only of A, B, C, D
    assert rows(sl.source_stats(marts)) == [(6, 4, 2, 4, 2018, 2020)]


def test_stats_count_countries_of_origins_only(edge):
    marts = edge([("AB", "E", 1)], routes=[("AB", "AAA", "BBB"), ("AC", "AAA", "CCC")])
    stats = dicts(sl.source_stats(marts))[0]
    assert (stats["routes"], stats["airports"], stats["countries"]) == (2, 3, 1)


# Matrix


def test_matrix_fills_missing_pairs_and_keeps_a_null_destination(edge):
    marts = edge([("AB", "E", 1_500), ("BA", "E", 2_000_000), ("AC", "E", 3)])
    cells = sl.region_matrix(sl.regional_revenue(marts, ALL))
    assert rows(cells) == [
        ("ASIA", None, 3.0, "$3"),
        ("ASIA", "ASIA", 0.0, "$0"),
        ("ASIA", "EUROPE", 1500.0, "$1.5K"),
        ("EUROPE", None, 0.0, "$0"),
        ("EUROPE", "ASIA", 2_000_000.0, "$2.0M"),
        ("EUROPE", "EUROPE", 0.0, "$0"),
    ]
    wide = sl.region_matrix_wide(cells)
    assert wide.columns == ["origin_continent", "ASIA", "EUROPE", "Unknown"]
    assert rows(wide) == [("ASIA", 0.0, 1500.0, 3.0), ("EUROPE", 2_000_000.0, 0.0, 0.0)]


def test_wide_matrix_with_named_destinations(edge):
    cells = sl.region_matrix(sl.regional_revenue(edge([("AB", "E", 1)]), ALL))
    wide = sl.region_matrix_wide(cells, ["EUROPE", "AFRICA"])
    assert rows(wide) == [("ASIA", 1.0, 0.0)]


def test_double_amounts_are_taken_as_money(spark, star):
    raw = star([("AB", "E", 1)], [("AB", "AAA", "BBB")], AIRPORT_ROWS)
    doubles = raw.tickets.withColumn("total_amount", F.lit(0.1))
    many = doubles.unionByName(doubles).unionByName(doubles)
    from skyledger.schemas import TICKETS

    mart = sl.revenue_by_route_class(sl.sources.conform(many, TICKETS))
    assert str(mart.first().revenue) == "0.30"
