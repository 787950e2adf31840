from __future__ import annotations

from pathlib import Path

import pytest

import skyledger as sl
from skyledger.__main__ import _jdbc_source, _parser, main
from tests.conftest import AIRPORT_ROWS, ROUTE_ROWS


def write_tables(star, folder, routes=ROUTE_ROWS):
    raw = star([("AB", "E", 10), ("BA", "B", 20)], routes, AIRPORT_ROWS)
    for name in ("tickets", "routes", "airports"):
        getattr(raw, name).write.parquet(f"{folder}/{name}.parquet")


def test_refresh_then_report(spark, star, tmp_path, capsys):
    tables, marts, out = (str(tmp_path / name) for name in ("tables", "marts", "out"))
    write_tables(star, tables)
    assert main(["refresh", "--tables", tables, "--marts", marts], spark) == 0
    assert main(["report", "--marts", marts, "--out", out, "--cabin", "Business"], spark) == 0
    assert Path(out, "top_routes.csv").read_text(encoding="utf-8").splitlines()[1].startswith("BA,1,20.0,20.0,Bville")
    assert "regional_revenue.csv" in capsys.readouterr().out


def test_a_failed_mart_shows_in_the_exit_code(spark, star, tmp_path):
    write_tables(star, str(tmp_path / "tables"), [*ROUTE_ROWS, ROUTE_ROWS[0]])
    arguments = ["refresh", "--tables", str(tmp_path / "tables"), "--marts", str(tmp_path / "m")]
    assert main(arguments, spark) == 1


def test_report_without_marts(spark, tmp_path):
    with pytest.raises(sl.MartsMissingError):
        main(["report", "--marts", str(tmp_path), "--out", str(tmp_path / "out")], spark)


def test_database_options_may_come_from_the_environment(monkeypatch):
    monkeypatch.setenv("PASSWORD_IN_ENV", "s=cret")
    arguments = "refresh --marts m --jdbc-url jdbc:x:y --schema S --option user=u".split()
    source = _jdbc_source(
        _parser().parse_args([*arguments, "--option-env", "password=PASSWORD_IN_ENV"])
    )
    assert source == sl.JdbcSource("jdbc:x:y", "S", {"user": "u", "password": "s=cret"})
    assert "s=cret" not in repr(source)
