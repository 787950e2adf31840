from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import skyledger as sl
from skyledger.plans.pushdown import builders_in_database
from skyledger.schemas import AIRPORTS, MART_COLUMNS, ROUTES, TICKETS
from skyledger.sources import conform, normalise_columns
from tests.conftest import AIRPORT_ROWS, ROUTE_ROWS, dicts, rows

SALES = [
    ("AB", "E", 10, datetime(2020, 1, 1)),
    ("AB", "E", None, datetime(2020, 2, 1)),
    ("BA", "B", 7, datetime(2021, 1, 1)),
    (None, None, 1, datetime(2021, 1, 1)),
]


def test_names_are_cleaned_and_values_kept(spark):
    df = normalise_columns(spark.createDataFrame([(" AbC ",)], "` Route_Code ` string"))
    assert df.columns == ["route_code"]
    assert rows(df) == [(" AbC ",)]


def test_names_that_collide_are_refused(spark):
    with pytest.raises(ValueError, match="ambiguous"):
        normalise_columns(spark.createDataFrame([(1, 2)], "a int, ` A` int"))


def test_conform_keeps_the_digits_of_a_decimal(spark):
    df = spark.createDataFrame(
        [("AB", "E", Decimal("1.2345"), Decimal(1), Decimal(1), datetime(2020, 1, 1), "extra")],
        "ROUTE_CODE string, CLASS string, TOTAL_AMOUNT decimal(31,4), AIRPORT_TAX decimal(31,2),"
        " LOCAL_TAX decimal(31,2), DEPARTURE timestamp_ntz, OTHER string",
    )
    found = conform(df, TICKETS)
    assert found.columns == TICKETS.names
    assert found.first().total_amount == Decimal("1.2345")


def test_conform_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="destination"):
        conform(spark.createDataFrame([("AB", "AAA")], "route_code string, origin string"), ROUTES)


def test_parquet_tables_round_trip(spark, star, tmp_path):
    made = star(SALES, ROUTE_ROWS, AIRPORT_ROWS)
    for name in ("tickets", "routes", "airports"):
        upper = getattr(made, name).toDF(*[c.upper() for c in getattr(made, name).columns])
        upper.write.parquet(f"{tmp_path}/{name}.parquet")
    read = sl.load_tables(spark, str(tmp_path))
    assert sorted(rows(read.tickets), key=str) == sorted(rows(made.tickets), key=str)
    assert read.tickets.schema == TICKETS
    assert sl.kpi_totals(sl.build_marts(read), sl.FilterSpec()).first().total_revenue == 17.0


def test_missing_marts_are_named(spark, tmp_path):
    with pytest.raises(sl.MartsMissingError, match="refresh_marts"):
        sl.read_marts(spark, str(tmp_path))


def test_marts_of_another_writer_are_read_by_name(spark, written, tmp_path):
    ours = sl.read_marts(spark, written)
    for name in MART_COLUMNS:
        df = getattr(ours, name)
        df.select(*reversed(df.columns)).toDF(*[c.upper() for c in reversed(df.columns)]).write.parquet(
            f"{tmp_path}/{name}.parquet"
        )
    marts = sl.read_marts(spark, str(tmp_path))
    assert marts.monthly_revenue.columns == MART_COLUMNS["monthly_revenue"]
    assert sl.list_years(marts).count() == 7


def test_marts_can_be_kept_and_released(marts):
    marts.persist()
    assert marts.monthly_revenue.storageLevel.useMemory
    assert marts.monthly_revenue.storageLevel.useDisk
    marts.unpersist()
    assert not marts.monthly_revenue.storageLevel.useMemory


class RecordingReader:
    """Stands in for a session's JDBC reader: keeps the options, loads from ``tables``.

    No database is started in tests, so statements are answered by Spark itself.
    """

    def __init__(self, tables, log):
        self.tables, self.log, self.found = tables, log, {}

    @property
    def read(self):
        return RecordingReader(self.tables, self.log)

    def format(self, name):
        assert name == "jdbc"
        return self

    def option(self, key, value):
        self.found[key] = value
        return self

    def options(self, **pairs):
        self.found.update(pairs)
        return self

    def load(self):
        self.log.append(self.found)
        return self.tables(self.found)


@pytest.fixture
def database(spark, star):
    raw = star(SALES, ROUTE_ROWS, AIRPORT_ROWS)
    for name in ("tickets", "routes", "airports"):
        getattr(raw, name).createOrReplaceTempView(f"wh_{name}")

    def answer(options):
        if "query" in options:
            df = spark.sql(options["query"].replace("WH.", "wh_"))
        else:
            df = spark.table(options["dbtable"].replace("WH.", "wh_"))
        return df.toDF(*[c.upper() for c in df.columns])

    log = []
    source = sl.JdbcSource("jdbc:x:y", "WH", {"user": "u", "password": "p", "fetchsize": "500"})
    return RecordingReader(answer, log), source, log, raw


def test_jdbc_tables_carry_the_callers_options(database):
    session, source, log, raw = database
    split = sl.ReadSplit("departure", "2020-01-01", "2022-01-01", 64)
    tables = source.load_tables(session, ticket_split=split)
    tickets, routes, _ = log
    assert tickets == {
        "url": "jdbc:x:y",
        "dbtable": "WH.tickets",
        "user": "u",
        "password": "p",
        "fetchsize": "500",
        "preferTimestampNTZ": "true",
        "partitionColumn": "departure",
        "lowerBound": "2020-01-01",
        "upperBound": "2022-01-01",
        "numPartitions": "64",
    }
    assert "partitionColumn" not in routes
    assert tables.tickets.schema == raw.tickets.schema


def test_marts_grouped_by_the_database_equal_those_grouped_by_spark(database):
    session, source, log, raw = database
    here = sl.build_marts(raw)
    for name, build in builders_in_database(session, source).items():
        there = build()
        assert there.columns == MART_COLUMNS[name]
        assert sorted(map(str, dicts(there))) == sorted(map(str, dicts(getattr(here, name))))
    assert [sorted(entry.keys() & {"query", "dbtable"})[0] for entry in log] == [
        "dbtable",
        "dbtable",
        "query",
        "query",
    ]


def test_jdbc_table_name_without_schema():
    assert sl.JdbcSource("jdbc:x:y").name_of("tickets") == "tickets"


def test_order_tables_mapping_has_the_documented_shape(spark):
    raw = sl.tables_from_orders(spark, "/root/testdata/sf0.001")
    for df, schema in ((raw.tickets, TICKETS), (raw.routes, ROUTES), (raw.airports, AIRPORTS)):
        assert dict(df.dtypes) == {f.name: f.dataType.simpleString() for f in schema.fields}
    assert (raw.airports.count(), raw.routes.count(), raw.tickets.count()) == (24, 600, 6000)
    assert raw.routes.filter(F.col("distance") == 0).count() > 0
