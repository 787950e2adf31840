"""Refreshing, reporting and exporting."""

from __future__ import annotations

import csv
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import skyledger as sl
from skyledger.plans import materialise
from skyledger.plans.export import export_csv
from skyledger.plans.materialise import _ensure_checkpoint_dir
from tests.conftest import AIRPORT_ROWS, ROUTE_ROWS, dicts, rows

ALL = sl.FilterSpec()


def read_csv(path) -> list[list[str]]:
    (part,) = Path(path).glob("part-*.csv") if Path(path).is_dir() else [Path(path)]
    with part.open(encoding="utf-8", newline="") as lines:
        return list(csv.reader(lines))


def test_refresh_reports_rows_and_overwrites(spark, star, tmp_path):
    first = star([("AB", "E", 1), ("BA", "B", 2)], ROUTE_ROWS, AIRPORT_ROWS)
    second = star([("AB", "E", 5)], ROUTE_ROWS, AIRPORT_ROWS)
    sl.refresh_marts(spark, first, str(tmp_path)).collect()
    status = rows(sl.refresh_marts(spark, second, str(tmp_path)))
    assert status == [
        ("routes_with_airports", 6, "written", None),
        ("revenue_by_route_class", 1, "written", None),
        ("monthly_revenue", 1, "written", None),
    ]
    marts = sl.read_marts(spark, str(tmp_path))
    assert dicts(sl.class_revenue(marts, ALL))[0]["revenue"] == 5.0


def test_refresh_refuses_a_repeated_route_and_goes_on(spark, star, tmp_path):
    twice = star([("AB", "E", 1)], [*ROUTE_ROWS, ROUTE_ROWS[0]], AIRPORT_ROWS)
    status = dicts(sl.refresh_marts(spark, twice, str(tmp_path)))
    assert [r["status"] for r in status] == ["failed", "written", "written"]
    assert "DuplicateRouteError" in status[0]["error"] and "AB" in status[0]["error"]
    assert not (tmp_path / "routes_with_airports.parquet").exists()


def test_refresh_refuses_a_repeated_airport(spark, star, tmp_path):
    twice = star([], ROUTE_ROWS, [*AIRPORT_ROWS, AIRPORT_ROWS[0]])
    status = dicts(sl.refresh_marts(spark, twice, str(tmp_path)))
    assert status[0]["status"] == "failed"


def test_refused_refresh_keeps_the_mart_written_before(spark, star, tmp_path):
    good = star([("AB", "E", 1)], ROUTE_ROWS, AIRPORT_ROWS)
    bad = star([("AB", "E", 1)], [*ROUTE_ROWS, ROUTE_ROWS[0]], AIRPORT_ROWS)
    sl.refresh_marts(spark, good, str(tmp_path)).collect()
    sl.refresh_marts(spark, bad, str(tmp_path)).collect()
    assert sl.read_marts(spark, str(tmp_path)).routes_with_airports.count() == 6


def test_failing_builder_is_one_status_row(spark, star, tmp_path):
    tables = star([("AB", "E", 1)], ROUTE_ROWS, AIRPORT_ROWS)

    def unreachable():
        raise ConnectionError("warehouse is down")

    builders = {**sl.mart_builders(tables), "revenue_by_route_class": unreachable}
    status = dicts(sl.refresh_marts(spark, builders, str(tmp_path)))
    assert [r["status"] for r in status] == ["written", "failed", "written"]
    assert status[1]["error"] == "ConnectionError: warehouse is down"
    with pytest.raises(sl.MartsMissingError, match="revenue_by_route_class"):
        sl.read_marts(spark, str(tmp_path))


def test_failure_while_computing_keeps_the_mart_written_before(spark, star, tmp_path):
    tables = star([("AB", "E", 1)], ROUTE_ROWS, AIRPORT_ROWS)
    sl.refresh_marts(spark, tables, str(tmp_path)).collect()
    broken = tables.tickets.withColumn("class", F.raise_error(F.lit("bad block")).cast("string"))
    builders = {
        **sl.mart_builders(tables),
        "monthly_revenue": lambda: sl.monthly_revenue(broken),
    }
    status = dicts(sl.refresh_marts(spark, builders, str(tmp_path)))
    assert [r["status"] for r in status] == ["written", "written", "failed"]
    assert "bad block" in status[2]["error"]
    assert sl.list_years(sl.read_marts(spark, str(tmp_path))).count() == 1


def test_report_gives_the_single_answers(marts):
    spec = sl.FilterSpec(classes=("E", "B"), continents=("ASIA", "EUROPE"), top_n=5)
    with sl.run_report(marts, spec) as answers:
        assert len(answers) == 12
        for name in (
            "kpi_totals",
            "top_routes",
            "class_revenue",
            "class_revenue_share",
            "continent_revenue",
            "regional_revenue",
            "monthly_trend",
            "monthly_by_class",
            "route_efficiency",
            "airport_revenue",
        ):
            assert rows(answers[name]) == rows(getattr(sl, name)(marts, spec)), name
        assert rows(answers["source_stats"]) == rows(sl.source_stats(marts))
        assert answers["region_matrix"].count() == 12
        kept = answers["regional_revenue"]
        assert kept.storageLevel.useDisk
    assert not kept.storageLevel.useMemory


def test_report_exports_four_files(marts, tmp_path):
    with sl.run_report(marts, ALL) as answers:
        paths = sl.export_report(answers, str(tmp_path))
        trend = dicts(answers["monthly_trend"])
        top = dicts(answers["top_routes"])
    assert sorted(Path(p).name for p in paths.values()) == [
        "monthly_trend.csv",
        "regional_revenue.csv",
        "revenue_by_airport.csv",
        "top_routes.csv",
    ]
    header, *lines = read_csv(paths["monthly_trend"])
    assert header == ["year", "month", "revenue", "ticket_count", "date"]
    assert [(int(y), int(m), float(r), int(n), d) for y, m, r, n, d in lines] == [
        (r["year"], r["month"], r["revenue"], r["ticket_count"], str(r["date"])) for r in trend
    ]
    header, *lines = read_csv(paths["top_routes"])
    assert header[-1] == "route_label"
    assert [line[-1] for line in lines] == [r["route_label"] for r in top]
    assert [float(line[2]) for line in lines] == [r["revenue"] for r in top]


def test_csv_nulls_text_and_numbers(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, None, "", None), (2, "São → “x”, y", 'q"q', 1058306884.49), (3, " a ", "b\nc", 5.0)],
        "i int, a string, b string, x double",
    ).coalesce(1)
    export_csv(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    text = part.read_text(encoding="utf-8").splitlines()
    assert text[:2] == ["i,a,b,x", "1,,,"]
    assert read_csv(tmp_path / "out")[2] == ["2", "São → “x”, y", 'q"q', "1058306884.49"]
    assert read_csv(tmp_path / "out")[3] == ["3", " a ", "b\nc", "5.0"]


@pytest.mark.parametrize("value", [0.0, 100.0, 0.05, 1e-9, 1 / 3, -2491379164.01, 1e12, 123456789012.34])
def test_csv_numbers_read_back_equal_and_have_no_exponent(spark, tmp_path, value):
    export_csv(spark.createDataFrame([(value,)], "x double").coalesce(1), str(tmp_path / "out"))
    text = read_csv(tmp_path / "out")[1][0]
    assert float(text) == value
    assert "e" not in text.lower()


def test_materialise_reads_back_from_the_shared_folder(spark):
    kept = materialise(spark.range(10).withColumn("x", F.col("id") * 2))
    assert kept.agg(F.sum("x")).first()[0] == 90
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "ExistingRDD" in plan
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured in spark.sparkContext.getCheckpointDir()


class SessionWithoutFolder:
    """A session that names no checkpoint folder, on a cluster or not."""

    def __init__(self, master, configured=None):
        self.master, self.configured, self.chosen = master, configured, None
        self.sparkContext = self.conf = self

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, folder):
        self.chosen = folder

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.configured or default


def test_checkpoint_folder_is_the_clusters():
    named = SessionWithoutFolder("spark://host:7077", "s3a://shared/checkpoints")
    _ensure_checkpoint_dir(named)
    assert named.chosen == "s3a://shared/checkpoints"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _ensure_checkpoint_dir(SessionWithoutFolder("spark://host:7077"))
    local = SessionWithoutFolder("local[2]")
    _ensure_checkpoint_dir(local)
    assert local.chosen


def test_reading_a_broken_mart_is_not_called_missing(spark, tmp_path):
    for name in ("routes_with_airports", "revenue_by_route_class", "monthly_revenue"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    with pytest.raises(AnalysisException):
        sl.read_marts(spark, str(tmp_path))
