"""Publications, incremental refreshes, jobs at the same time, rejects and CSV files."""

from __future__ import annotations

import json
import os
import threading
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

import skyledger as sl
from skyledger.operators import marts as mart_operators
from skyledger.plans import incremental, marts_of_one_reading, refresh
from skyledger.plans.together import Failed, once, together
from skyledger.schemas import MART_COLUMNS
from skyledger.sources import files, publications
from skyledger.sources.publications import OvertakenError, Publication, latest, publish, publish_marts
from skyledger.sources.tables import conform, conform_checked
from tests.conftest import AIRPORT_ROWS, MEDIUM, ROUTE_ROWS, SMALL, dicts, money, plan_text, rows

ALL = sl.FilterSpec()


def in_order(df):
    return sorted(rows(df), key=str)


def same_marts(one: sl.Marts, other: sl.Marts) -> None:
    for name in MART_COLUMNS:
        a, b = getattr(one, name), getattr(other, name)
        assert a.dtypes == b.dtypes, name
        assert in_order(a) == in_order(b), name


# One reading of derived tickets.


def test_marts_of_partials_are_the_marts(spark, star):
    march = datetime(2021, 3, 1)
    tickets = [("AB", "E", 1), ("AB", "E", None), ("AB", "E", 2, march), ("BA", None, None, march), (None, "X", 3, None)]
    raw = star(tickets, ROUTE_ROWS, AIRPORT_ROWS)
    partials = mart_operators.ticket_partials(raw.tickets)
    split = mart_operators.merged_partials(
        mart_operators.ticket_partials(raw.tickets.filter("class = 'E'")).unionByName(
            mart_operators.ticket_partials(raw.tickets.filter("class is distinct from 'E'"))
        )
    )
    for found in (partials, split):
        same_marts(sl.Marts(mart_operators.builders_from_partials(raw, lambda f=found: f)), sl.build_marts(raw))


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_derived_tickets_are_read_once_in_a_refresh(spark, tmp_path, monkeypatch, folder):
    asked = []
    monkeypatch.setattr(refresh, "ticket_partials", lambda t: asked.append(t) or mart_operators.ticket_partials(t))
    plain = []
    monkeypatch.setattr(mart_operators, "revenue_by_route_class", lambda t: plain.append(t))
    raw = sl.tables_from_orders(spark, folder)
    builders = refresh._derived(spark, raw, str(tmp_path))
    plans = [plan_text(build()) for name, build in builders.items() if name != "routes_with_airports"]
    assert len(asked) == 1 and not plain
    assert all("Join" not in plan and "lineitem" not in plan for plan in plans)
    assert "Join" in plan_text(mart_operators.ticket_partials(raw.tickets))


def test_refresh_of_derived_tickets_equals_the_marts(spark, tmp_path):
    raw = sl.tables_from_orders(spark, MEDIUM, derived=True)
    sl.refresh_marts(spark, raw, str(tmp_path)).collect()
    same_marts(sl.read_marts(spark, str(tmp_path)), sl.build_marts(raw))


def test_a_failing_reading_fails_both_revenue_marts_alone(spark, tmp_path):
    raw = sl.tables_from_orders(spark, SMALL)
    broken = raw.tickets.withColumn("class", F.raise_error(F.lit("bad block")).cast("string"))
    tables = sl.RawTables(broken, raw.routes, raw.airports, derived=True)
    status = dicts(sl.refresh_marts(spark, tables, str(tmp_path)))
    assert [r["status"] for r in status] == ["written", "failed", "failed"]
    assert all("bad block" in r["error"] for r in status[1:])


def test_rows_are_counted_while_they_are_written(spark, star, tmp_path, monkeypatch):
    raw = star([("AB", "E", 1), ("BA", "B", 2)], ROUTE_ROWS, AIRPORT_ROWS)
    read = []
    kept = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths: read.extend(paths) or kept(self, *paths))
    status = rows(sl.refresh_marts(spark, raw, str(tmp_path)))
    assert [r[:3] for r in status] == [
        ("routes_with_airports", 6, "written"),
        ("revenue_by_route_class", 2, "written"),
        ("monthly_revenue", 2, "written"),
    ]
    assert [Path(p).name for p in read] == ["routes_with_airports.parquet"]


def test_an_empty_fact_is_written_with_no_rows(spark, star, tmp_path):
    status = rows(sl.refresh_marts(spark, star([], ROUTE_ROWS, AIRPORT_ROWS), str(tmp_path)))
    assert [r[1] for r in status] == [6, 0, 0]
    assert sl.class_revenue(sl.read_marts(spark, str(tmp_path)), ALL).count() == 0


# Publications.


def test_a_name_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "a.json")
    assert files.create_if_absent(spark, path, "first →")
    assert not files.create_if_absent(spark, path, "second")
    assert files.read_text(spark, path) == "first →"
    assert [e.name for e in files.entries(spark, str(tmp_path)) if not e.name.endswith(".crc")] == ["a.json"]
    assert files.entries(spark, str(tmp_path / "none")) == []


def test_of_two_publications_after_one_the_second_is_told(spark, tmp_path):
    folder = str(tmp_path)
    base = latest(spark, folder)
    assert base.number == 0
    assert publish(spark, folder, base, Publication(marts={"a": "runs/1"})).number == 1
    with pytest.raises(OvertakenError):
        publish(spark, folder, base, Publication(marts={"a": "runs/2"}))
    assert latest(spark, folder).marts == {"a": "runs/1"}


def test_publications_at_the_same_time_get_a_number_each(spark, tmp_path):
    folder, n = str(tmp_path), 8
    barrier = threading.Barrier(n)

    def one(k):
        barrier.wait()
        return publish_marts(spark, folder, {f"mart{k}": f"runs/{k}"}).number

    numbers = together(spark, {str(k): lambda k=k: one(k) for k in range(n)})
    assert sorted(numbers.values()) == list(range(1, n + 1))
    assert latest(spark, folder).marts == {f"mart{k}": f"runs/{k}" for k in range(n)}


def test_two_interleaved_refreshes(spark, star, tmp_path, monkeypatch):
    """The second begins and ends between the first one's writing and its publication."""
    folder = str(tmp_path)
    first = star([("AB", "E", 1)], ROUTE_ROWS, AIRPORT_ROWS)
    second = star([("AB", "E", 2)], ROUTE_ROWS, AIRPORT_ROWS)

    def unreachable():
        raise ConnectionError("warehouse is down")

    partly = {**sl.mart_builders(first), "monthly_revenue": unreachable}
    kept, numbers = refresh.publish_marts, []

    def late(*arguments):
        monkeypatch.setattr(refresh, "publish_marts", kept)
        sl.refresh_marts(spark, second, folder).collect()
        numbers.append(latest(spark, folder).number)
        published = kept(*arguments)
        numbers.append(published.number)
        return published

    monkeypatch.setattr(refresh, "publish_marts", late)
    sl.refresh_marts(spark, partly, folder).collect()
    assert numbers == [1, 2]
    marts = sl.read_marts(spark, folder)
    # The first published last; the mart that it could not write is the second's.
    assert dicts(sl.class_revenue(marts, ALL))[0]["revenue"] == 1.0
    assert dicts(sl.monthly_trend(marts, ALL))[0]["revenue"] == 2.0


def age(folder: Path, hours: float) -> None:
    for path in folder.rglob("*"):
        then = path.stat().st_mtime - hours * 3600
        os.utime(path, (then, then))


def test_clearing_spares_what_is_published_and_what_is_young(spark, star, tmp_path):
    folder = str(tmp_path)
    for amount in (1, 2, 3):
        sl.refresh_marts(spark, star([("AB", "E", amount)], ROUTE_ROWS, AIRPORT_ROWS), folder).collect()
    assert sl.clear_old_runs(spark, folder, keep=1) == []  # all of it is young
    age(tmp_path, 30)
    (tmp_path / "runs" / "unpublished").mkdir()
    gone = sl.clear_old_runs(spark, folder, keep=1)
    assert len([p for p in gone if p.startswith("runs/")]) == 2
    assert {p for p in gone if p.startswith("published/")} == {f"published/{n:010d}.json" for n in (1, 2)}
    left = {p.name for p in (tmp_path / "runs").iterdir()}
    assert left == {"unpublished", *(Path(r).name for r in latest(spark, folder).marts.values())}
    assert dicts(sl.class_revenue(sl.read_marts(spark, folder), ALL))[0]["revenue"] == 3.0
    with pytest.raises(ValueError):
        sl.clear_old_runs(spark, folder, keep=0)
    sl.refresh_marts(spark, star([("AB", "E", 4)], ROUTE_ROWS, AIRPORT_ROWS), folder).collect()
    assert latest(spark, folder).number == 4  # numbers go on


# Incremental refreshes.


def tables_in(star, folder, tickets, name="0"):
    raw = star(tickets, ROUTE_ROWS, AIRPORT_ROWS)
    for table in ("routes", "airports"):
        getattr(raw, table).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    add_file(raw, folder, name)


def add_file(raw, folder, name):
    raw.tickets.coalesce(1).write.parquet(f"{folder}/new-{name}")
    (part,) = Path(folder, f"new-{name}").glob("part-*.parquet")
    Path(folder, "tickets.parquet").mkdir(exist_ok=True)
    os.rename(part, Path(folder, "tickets.parquet", f"{name}.parquet"))


def test_a_refresh_reads_the_new_file_only(spark, star, tmp_path):
    tables, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    tables_in(star, tables, [("AB", "E", 1), ("BA", "B", None), ("AB", None, 7)])
    first = rows(sl.refresh_new_files(spark, tables, marts))
    assert [r[:3] for r in first] == [
        ("routes_with_airports", 6, "written"), ("revenue_by_route_class", 3, "written"), ("monthly_revenue", 3, "written")
    ]
    add_file(star([("AB", "E", 2, datetime(2021, 5, 1)), ("CA", "P", 3)]), tables, "1")
    wanted = sl.load_tables(spark, tables)
    expected = {name: in_order(getattr(sl.build_marts(wanted), name)) for name in MART_COLUMNS}
    # The first file cannot be read any more, but looks as it did.
    old = Path(tables, "tickets.parquet", "0.parquet")
    seen = old.stat()
    old.write_bytes(b"x" * seen.st_size)
    os.utime(old, ns=(seen.st_atime_ns, seen.st_mtime_ns))
    Path(tables, "tickets.parquet", ".0.parquet.crc").unlink(missing_ok=True)
    status = rows(sl.refresh_new_files(spark, tables, marts))
    assert [r[2] for r in status] == ["written"] * 3
    found = sl.read_marts(spark, marts)
    assert {name: in_order(getattr(found, name)) for name in MART_COLUMNS} == expected
    published = latest(spark, marts)
    assert len(published.partials) == 2
    read = spark.read.parquet(f"{marts}/{published.partials[1]}").agg(F.sum("ticket_count")).first()[0]
    assert read == 2  # of five tickets, those of the new file


def test_nothing_new_reads_no_tickets(spark, star, tmp_path):
    tables, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    tables_in(star, tables, [("AB", "E", 1)])
    sl.refresh_new_files(spark, tables, marts).collect()
    before = latest(spark, marts)
    sl.refresh_new_files(spark, tables, marts).collect()
    after = latest(spark, marts)
    assert after.number == before.number + 1 and after.partials == before.partials
    same_marts(sl.read_marts(spark, marts), sl.build_marts(sl.load_tables(spark, tables)))


@pytest.mark.parametrize("how", ["changed", "removed"])
def test_a_file_that_changed_or_went_means_all_anew(spark, star, tmp_path, how):
    tables, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    tables_in(star, tables, [("AB", "E", 1)])
    add_file(star([("BA", "B", 5)]), tables, "1")
    sl.refresh_new_files(spark, tables, marts).collect()
    os.unlink(Path(tables, "tickets.parquet", "1.parquet"))
    if how == "changed":
        add_file(star([("BA", "B", 6), ("BD", "P", 1)]), tables, "1b")
        os.rename(Path(tables, "tickets.parquet", "1b.parquet"), Path(tables, "tickets.parquet", "1.parquet"))
    sl.refresh_new_files(spark, tables, marts).collect()
    assert len(latest(spark, marts).partials) == 1
    same_marts(sl.read_marts(spark, marts), sl.build_marts(sl.load_tables(spark, tables)))


def test_many_sets_are_merged_into_one(spark, star, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_SETS", 2)
    tables, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    tables_in(star, tables, [("AB", "E", 1)])
    counts = []
    for k in range(1, 4):
        sl.refresh_new_files(spark, tables, marts).collect()
        counts.append(len(latest(spark, marts).partials))
        add_file(star([("AB", "E", k), ("BA", None, None)]), tables, str(k))
    sl.refresh_new_files(spark, tables, marts).collect()
    assert [*counts, len(latest(spark, marts).partials)] == [1, 2, 1, 2]
    same_marts(sl.read_marts(spark, marts), sl.build_marts(sl.load_tables(spark, tables)))
    age(Path(marts), 30)
    sl.clear_old_runs(spark, marts, keep=1)
    sl.refresh_new_files(spark, tables, marts).collect()
    same_marts(sl.read_marts(spark, marts), sl.build_marts(sl.load_tables(spark, tables)))


def test_an_overtaken_refresh_starts_over(spark, star, tmp_path, monkeypatch):
    tables, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    tables_in(star, tables, [("AB", "E", 1)])
    kept = incremental.publish

    def late(*arguments):
        monkeypatch.setattr(incremental, "publish", kept)
        sl.refresh_new_files(spark, tables, marts).collect()  # takes in the same file
        return kept(*arguments)

    monkeypatch.setattr(incremental, "publish", late)
    sl.refresh_new_files(spark, tables, marts).collect()
    published = latest(spark, marts)
    assert published.number == 2 and len(published.partials) == 1
    assert dicts(sl.class_revenue(sl.read_marts(spark, marts), ALL))[0]["revenue"] == 1.0


def test_a_full_refresh_forgets_the_ledger(spark, star, tmp_path):
    tables, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    tables_in(star, tables, [("AB", "E", 1)])
    sl.refresh_new_files(spark, tables, marts).collect()
    sl.refresh_marts(spark, star([("AB", "E", 9)], ROUTE_ROWS, AIRPORT_ROWS), marts).collect()
    assert latest(spark, marts).ledger is None
    sl.refresh_new_files(spark, tables, marts).collect()
    assert dicts(sl.class_revenue(sl.read_marts(spark, marts), ALL))[0]["revenue"] == 1.0


def test_tickets_that_cannot_be_read_leave_marts_and_ledger(spark, star, tmp_path):
    tables, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    tables_in(star, tables, [("AB", "E", 1)])
    sl.refresh_new_files(spark, tables, marts).collect()
    before = latest(spark, marts)
    Path(tables, "tickets.parquet", "broken.parquet").write_bytes(b"no parquet")
    status = rows(sl.refresh_new_files(spark, tables, marts))
    assert [r[2] for r in status] == ["written", "failed", "failed"]
    after = latest(spark, marts)
    assert (after.ledger, after.partials) == (before.ledger, before.partials)
    assert dicts(sl.class_revenue(sl.read_marts(spark, marts), ALL))[0]["revenue"] == 1.0


# Jobs at the same time.


def test_jobs_run_together_and_fail_alone(spark):
    barrier = threading.Barrier(3, timeout=60)

    def meet(k):
        barrier.wait()  # only passed if all three run at once
        if k == 1:
            raise ValueError("one")
        return spark.range(k).count(), spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    spark.sparkContext.setLocalProperty("callSite.short", "here")
    found = together(spark, {str(k): lambda k=k: meet(k) for k in range(3)})
    assert list(found) == ["0", "1", "2"]
    assert found["0"] == (0, "0") and found["2"] == (2, "2")
    assert isinstance(found["1"], Failed) and isinstance(found["1"].cause, ValueError)
    assert together(spark, {}) == {}


def test_once_is_made_once_and_fails_for_all(spark):
    made = []
    get = once(lambda: made.append(1) or len(made))
    assert together(spark, {str(k): get for k in range(5)}) == {str(k): 1 for k in range(5)}
    broken = once(lambda: 1 / 0)
    assert all(isinstance(r, Failed) for r in together(spark, {"a": broken, "b": broken}).values())


# Rejected rows.

BAD = [
    ("AB", "E", 1.25, "fine"),
    ("AB", "E", None, "a null is no fault"),
    ("AB", "E", float("nan"), "not finite"),
    ("AB", "E", float("-inf"), "not finite"),
    ("AB", "E", 1e300, "too large"),
    ("AB", "E", 0.123, "not exact"),
]


def bad_tickets(spark):
    when = datetime(2020, 1, 1)
    made = [(r, c, x, money(1), money(2), when, note) for r, c, x, note in BAD]
    return spark.createDataFrame(
        made, "route_code string, class string, Total_Amount double, airport_tax decimal(12,2),"
        " local_tax decimal(12,2), departure timestamp_ntz, note string",
    )


def test_one_bad_row_of_each_kind_is_rejected_with_its_reason(spark):
    from skyledger.schemas import TICKETS

    good, rejects = conform_checked(bad_tickets(spark), TICKETS, "tickets")
    assert [r.total_amount for r in good.collect()] == [Decimal("1.25"), None]
    found = rejects.collect()
    assert sorted(json.loads(r.row)["note"] for r in found) == sorted(r.faults[0].reason for r in found)
    assert all(len(r.faults) == 1 and r.faults[0].column == "total_amount" for r in found)
    assert rows(sl.reject_counts(rejects)) == [
        ("tickets", "total_amount", "not exact", 1),
        ("tickets", "total_amount", "not finite", 2),
        ("tickets", "total_amount", "too large", 1),
    ]
    with pytest.raises(SparkRuntimeException, match="total_amount"):
        conform(bad_tickets(spark), TICKETS).collect()  # still an error where rejects are not asked for


def test_texts_that_are_no_number_or_time_are_rejected(spark):
    from skyledger.schemas import ROUTES, TICKETS

    made = spark.createDataFrame(
        [("AB", "E", "1.5", "1", "1", "2020-01-01 00:00:00"), ("AB", "E", "x", "1", "?", "never")],
        "route_code string, class string, total_amount string, airport_tax string, local_tax string, departure string",
    )
    good, rejects = conform_checked(made, TICKETS, "tickets")
    assert rows(good) == rows(conform(made.limit(1), TICKETS)) and good.dtypes == conform(made, TICKETS).dtypes
    (row,) = rejects.collect()
    assert {(f.column, f.value) for f in row.faults} == {("total_amount", "x"), ("local_tax", "?"), ("departure", "never")}
    routes = spark.createDataFrame(
        [("AB", "A", "B", 1.5, 90, None, 1), ("BA", "B", "A", 1.5, 1 << 40, None, 1)],
        "route_code string, origin string, destination string, distance double, flight_minutes bigint,"
        " parent_route string, leg_number int",
    )
    good, rejects = conform_checked(routes, ROUTES, "routes")
    assert [r.route_code for r in good.collect()] == ["AB"]
    assert rows(sl.reject_counts(rejects)) == [("routes", "flight_minutes", "not a int", 1)]


def test_checked_tables_without_faults_are_the_tables(spark, star, tmp_path):
    tables = str(tmp_path)
    tables_in(star, tables, [("AB", "E", 1), ("BA", None, None)])
    found, rejects = sl.load_checked_tables(spark, tables)
    wanted = sl.load_tables(spark, tables)
    for name in ("tickets", "routes", "airports"):
        assert getattr(found, name).dtypes == getattr(wanted, name).dtypes
        assert in_order(getattr(found, name)) == in_order(getattr(wanted, name))
    assert rejects.count() == 0 and sl.reject_counts(rejects).count() == 0


def test_refresh_with_rejects_from_the_command_line(spark, star, tmp_path, capsys):
    from skyledger.__main__ import main

    tables, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    raw = star([], ROUTE_ROWS, AIRPORT_ROWS)
    raw.routes.write.parquet(f"{tables}/routes.parquet")
    raw.airports.write.parquet(f"{tables}/airports.parquet")
    bad_tickets(spark).write.parquet(f"{tables}/tickets.parquet")
    assert main(["refresh", "--tables", tables, "--marts", marts], spark) == 1
    arguments = ["refresh", "--tables", tables, "--marts", marts, "--rejects", str(tmp_path / "rejects")]
    assert main(arguments, spark) == 0
    assert "not exact" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 4
    assert dicts(sl.class_revenue(sl.read_marts(spark, marts), ALL))[0]["revenue"] == 1.25
    assert main(["clear", "--marts", marts, "--keep", "1", "--hours", "0"], spark) == 0
    assert "runs/" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["refresh", "--jdbc-url", "jdbc:x:y", "--marts", marts, "--new-files"], spark)


def test_new_files_from_the_command_line(spark, star, tmp_path):
    from skyledger.__main__ import main

    tables, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    tables_in(star, tables, [("AB", "E", 1)])
    assert main(["refresh", "--tables", tables, "--marts", marts, "--new-files"], spark) == 0
    assert latest(spark, marts).ledger


# CSV files.


def test_a_csv_file_is_one_file_and_replaces_what_was_there(spark, tmp_path):
    path = tmp_path / "answer.csv"
    sl.export_csv_file(spark.range(3).repartition(3).orderBy("id"), str(path))
    assert path.is_file() and path.read_text() == "id\n0\n1\n2\n"
    sl.export_csv_file(spark.range(1), str(path))
    assert path.read_text() == "id\n0\n"
    sl.export_csv_file(spark.range(0), str(path))
    assert path.read_text() == "id\n"
    # A folder of an earlier version makes room for the file.
    sl.export_csv(spark.range(2), str(tmp_path / "old.csv"))
    sl.export_csv_file(spark.range(2), str(tmp_path / "old.csv"))
    assert (tmp_path / "old.csv").is_file()
    assert {p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")} == {"answer.csv", "old.csv"}


def test_a_failing_answer_leaves_the_old_file_and_nothing_half_written(spark, tmp_path):
    path = tmp_path / "answer.csv"
    sl.export_csv_file(spark.range(2), str(path))
    broken = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("late"))).alias("id"))
    with pytest.raises(Exception, match="late"):
        sl.export_csv_file(broken, str(path))
    assert path.read_text() == "id\n0\n1\n"
    assert {p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")} == {"answer.csv"}


def test_one_failing_answer_of_a_report_spares_the_others(spark, marts, tmp_path):
    with sl.run_report(marts, ALL) as answers:
        broken = answers["top_routes"].withColumn("revenue", F.raise_error(F.lit("no answer")).cast("double"))
        with pytest.raises(Exception, match="no answer"):
            sl.export_report({**answers, "top_routes": broken}, str(tmp_path))
    names = {p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")}
    assert names == {"monthly_trend.csv", "revenue_by_airport.csv", "regional_revenue.csv"}


def test_publications_are_plain_json(spark, tmp_path):
    publish_marts(spark, str(tmp_path), {"a": "runs/1"})
    found = json.loads((tmp_path / "published" / "0000000001.json").read_text())
    assert found == {"marts": {"a": "runs/1"}, "buckets": {}, "partials": [], "ledger": None}
    assert publications.PARTIALS == "partials"


def test_source_stats_of_derived_tickets_reads_them_once(spark):
    raw = sl.tables_from_orders(spark, SMALL)
    once_read = sl.source_stats(marts_of_one_reading(raw))
    assert rows(once_read) == rows(sl.source_stats(sl.build_marts(raw)))
    assert "l_orderkey" not in plan_text(once_read)


# Marts in buckets.


def answers_about_places(marts):
    return {
        "top_routes": sl.top_routes(marts, ALL),
        "continent_revenue": sl.continent_revenue(marts, ALL),
        "route_efficiency": sl.route_efficiency(marts, ALL),
        "airport_revenue": sl.airport_revenue(marts, ALL),
        "kpi_totals": sl.kpi_totals(marts, ALL),
        "regional_revenue": sl.regional_revenue(marts, ALL),
    }


def test_grouping_and_joining_marts_in_buckets_moves_no_row(spark, tmp_path, marts):
    folder = str(tmp_path)
    status = rows(sl.refresh_marts(spark, sl.tables_from_orders(spark, MEDIUM), folder, buckets=4))
    assert [r[1] for r in status] == [getattr(marts, name).count() for name in MART_COLUMNS]
    assert latest(spark, folder).buckets == {"routes_with_airports": 4, "revenue_by_route_class": 4}
    divided = sl.read_marts(spark, folder)
    same_marts(divided, marts)
    wanted = {name: rows(answer) for name, answer in answers_about_places(marts).items()}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as beyond the broadcast size
    try:
        rollup = mart_rollup(divided)
        assert "Exchange" not in plan_text(rollup) and "Join" in plan_text(rollup)
        assert plan_text(mart_rollup(marts)).count("Exchange") >= 2
        for name, answer in answers_about_places(divided).items():
            assert rows(answer) == wanted[name], name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def mart_rollup(marts):
    from skyledger.operators.rollup import route_rollup

    return route_rollup(marts, ALL.classes)


def test_buckets_come_and_go_with_their_publication(spark, star, tmp_path):
    tables, folder = str(tmp_path / "tables"), str(tmp_path / "it's marts")
    tables_in(star, tables, [("AB", "E", 1), ("BA", "B", 2)])
    sl.refresh_new_files(spark, tables, folder, buckets=3).collect()
    assert latest(spark, folder).buckets == {"routes_with_airports": 3, "revenue_by_route_class": 3}
    assert sl.class_revenue(sl.read_marts(spark, folder), ALL).count() == 2
    sl.refresh_marts(spark, sl.load_tables(spark, tables), folder).collect()
    assert latest(spark, folder).buckets == {}
    assert sl.class_revenue(sl.read_marts(spark, folder), ALL).count() == 2


def test_a_mart_that_fails_in_buckets_leaves_no_table(spark, star, tmp_path):
    raw = star([("AB", "E", 1)], ROUTE_ROWS, AIRPORT_ROWS)
    before = {t.name for t in spark.catalog.listTables()}
    broken = raw.tickets.withColumn("class", F.raise_error(F.lit("bad block")).cast("string"))
    status = rows(sl.refresh_marts(spark, sl.RawTables(broken, raw.routes, raw.airports), str(tmp_path), buckets=2))
    assert [r[2] for r in status] == ["written", "failed", "failed"]
    assert {t.name for t in spark.catalog.listTables()} == before
