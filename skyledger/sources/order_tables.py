"""The star schema derived from order tables (lineitem, orders, customer, ...).

Every line item is a ticket from the nation of its supplier to the nation of its
customer. The rules leave nulls, zeros, orphans and unknown codes in on purpose,
so that the questions meet them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.sources.tables import RawTables

# Fixed value: codes have two digits for a nation.
LAST_CODE = 99

# The columns used. Naming them spares a job per table that would infer them.
ORDER_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_shipdate timestamp_ntz"
    ),
}


def _two_digits(key: str) -> str:
    """Key 7 as 07; a key that has no two digits is an error, not another key's code."""
    refused = f"raise_error(concat('nation key ', cast({key} as string), ' is not in 0..{LAST_CODE}'))"
    return (
        f"CASE WHEN {key} IS NULL OR {key} BETWEEN 0 AND {LAST_CODE}"
        f" THEN lpad(cast({key} as string), 2, '0') ELSE {refused} END"
    )


def _airport_code(nation: str) -> str:
    return f"concat('N', {_two_digits(nation)})"


def _airports(nation: DataFrame, region: DataFrame) -> DataFrame:
    return (
        nation.filter("n_nationkey <> 22")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr(
            f"{_airport_code('n_nationkey')} AS iata_code",
            "concat(n_name, ' Intl') AS airport",
            "CASE WHEN n_nationkey % 11 <> 10 THEN n_name END AS city",
            "n_name AS country",
            "CASE WHEN n_nationkey <> 24 THEN r_name END AS continent",
            "cast(CASE WHEN n_nationkey <> 23 THEN n_nationkey * 5 - 60 END AS decimal(9,6))"
            " AS latitude",
            "cast(n_nationkey * 14 - 170 AS decimal(9,6)) AS longitude",
            "cast(n_nationkey + 5 AS decimal(6,2)) AS airport_tax",
        )
    )


def _routes(nation: DataFrame) -> DataFrame:
    """A route from every nation to every other one.

    Each origin fans out over the range of nation keys there are, and an equi-join
    keeps the destinations that exist.
    """
    key = F.col("n_nationkey")
    first = nation.agg(F.greatest(F.min(key), F.lit(0))).scalar()
    last = nation.agg(F.least(F.max(key), F.lit(LAST_CODE))).scalar()
    axis = F.when(first <= last, F.sequence(first, last))
    origins = nation.select(key.alias("o"), F.explode(axis).alias("d"))
    return (
        origins.filter("o <> d")
        .join(nation.selectExpr("n_nationkey AS d"), "d")
        .selectExpr(
            f"concat('R', {_two_digits('o')}, {_two_digits('d')}) AS route_code",
            f"{_airport_code('o')} AS origin",
            f"{_airport_code('d')} AS destination",
            "cast(CASE WHEN (o + d) % 23 = 0 THEN NULL WHEN (o * d) % 29 = 1 THEN 0"
            " ELSE abs(o - d) * 375 + o * 7 + d * 3 END AS decimal(8,1)) AS distance",
            "abs(o - d) * 25 + 30 AS flight_minutes",
            f"CASE WHEN d % 5 = 0 THEN concat('R', {_two_digits('o')}, '00') END AS parent_route",
            "d % 2 + 1 AS leg_number",
        )
    )


def _tickets(
    lineitem: DataFrame, orders: DataFrame, customer: DataFrame, supplier: DataFrame
) -> DataFrame:
    """One ticket per line item.

    The buyer side is joined first, on two narrow tables, so that the line items
    cross the network once per key (order, supplier) and never by customer. The
    ticket columns are computed below the joins, so that only they are shuffled,
    and the halves of a route code on the small sides, once per party.
    """
    price = "cast(l_extendedprice AS decimal(12,2))"

    def share_of_price(rate: str) -> str:
        return f"cast({price} * cast({rate} AS decimal(4,2)) AS decimal(12,2))"

    lines = lineitem.selectExpr(
        "l_orderkey",
        "l_suppkey",
        "CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'X'"
        " WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL"
        " WHEN l_returnflag = 'A' THEN 'E'"
        " WHEN l_returnflag = 'N' THEN 'P'"
        " ELSE 'B' END AS class",
        f"CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN NULL ELSE {price} END"
        " AS total_amount",
        f"{share_of_price('l_tax')} AS airport_tax",
        f"{share_of_price('l_discount')} AS local_tax",
        "l_shipdate AS departure",
    )
    sellers = supplier.selectExpr("s_suppkey", f"{_two_digits('s_nationkey')} AS seller")
    homes = customer.selectExpr("c_custkey", f"{_two_digits('c_nationkey')} AS buyer")
    buyers = orders.join(homes, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "buyer"
    )
    return (
        lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr(
            "concat('R', seller, buyer) AS route_code",
            "class",
            "total_amount",
            "airport_tax",
            "local_tax",
            "departure",
        )
    )


def tables_from_orders(spark: SparkSession, folder: str, derived: bool = False) -> RawTables:
    """``derived``: read the tickets once in a refresh, which pays where the joins are long."""
    read = {
        name: spark.read.schema(columns).parquet(f"{folder}/{name}.parquet")
        for name, columns in ORDER_TABLES.items()
    }
    return RawTables(
        tickets=_tickets(read["lineitem"], read["orders"], read["customer"], read["supplier"]),
        routes=_routes(read["nation"]),
        airports=_airports(read["nation"], read["region"]),
        derived=derived,
    )
