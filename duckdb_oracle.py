"""DuckDB SQL giving the expected rows of every registered query.

Written on its own, against the order tables: the mapping to the star schema and
the marts are CTEs that each statement begins with.
"""

from __future__ import annotations

STAR = """
airports AS (
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iata_code,
         n_name || ' Intl' AS airport,
         CASE WHEN n_nationkey % 11 <> 10 THEN n_name END AS city,
         n_name AS country,
         CASE WHEN n_nationkey <> 24 THEN r_name END AS continent,
         CAST(CASE WHEN n_nationkey <> 23 THEN n_nationkey * 5 - 60 END AS DECIMAL(9,6)) AS latitude,
         CAST(n_nationkey * 14 - 170 AS DECIMAL(9,6)) AS longitude,
         CAST(n_nationkey + 5 AS DECIMAL(6,2)) AS airport_tax
  FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey <> 22
),
routes AS (
  SELECT 'R' || lpad(CAST(o AS VARCHAR), 2, '0') || lpad(CAST(d AS VARCHAR), 2, '0') AS route_code,
         'N' || lpad(CAST(o AS VARCHAR), 2, '0') AS origin,
         'N' || lpad(CAST(d AS VARCHAR), 2, '0') AS destination,
         CAST(CASE WHEN (o + d) % 23 = 0 THEN NULL
                   WHEN (o * d) % 29 = 1 THEN 0
                   ELSE abs(o - d) * 375 + o * 7 + d * 3 END AS DECIMAL(8,1)) AS distance,
         CAST(30 + abs(o - d) * 25 AS INTEGER) AS flight_minutes,
         CASE WHEN d % 5 = 0 THEN 'R' || lpad(CAST(o AS VARCHAR), 2, '0') || '00' END AS parent_route,
         CAST(1 + d % 2 AS INTEGER) AS leg_number
  FROM (SELECT a.n_nationkey AS o, b.n_nationkey AS d
        FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey)
),
tickets AS (
  SELECT 'R' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')
             || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS route_code,
         CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'X'
              WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL
              WHEN l_returnflag = 'A' THEN 'E'
              WHEN l_returnflag = 'N' THEN 'P'
              ELSE 'B' END AS class,
         CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN NULL
              ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS total_amount,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS airport_tax,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS local_tax,
         l_shipdate AS departure
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
)"""

MARTS = """
route_class AS (
  SELECT route_code, class, count(*) AS ticket_count, sum(total_amount) AS revenue,
         CAST(sum(total_amount) AS DOUBLE) / nullif(count(total_amount), 0) AS avg_ticket_value,
         sum(airport_tax) AS total_airport_tax, sum(local_tax) AS total_local_tax
  FROM tickets GROUP BY ALL
),
monthly AS (
  SELECT CAST(year(departure) AS INTEGER) AS year, CAST(month(departure) AS INTEGER) AS month,
         class, count(*) AS ticket_count, sum(total_amount) AS revenue
  FROM tickets GROUP BY ALL
),
network AS (
  SELECT r.*,
         o.airport AS origin_airport, o.city AS origin_city, o.country AS origin_country,
         o.continent AS origin_continent, o.latitude AS origin_lat, o.longitude AS origin_lon,
         o.airport_tax AS origin_tax,
         d.airport AS dest_airport, d.city AS dest_city, d.country AS dest_country,
         d.continent AS dest_continent, d.latitude AS dest_lat, d.longitude AS dest_lon,
         d.airport_tax AS dest_tax
  FROM routes r
  JOIN airports o ON r.origin = o.iata_code
  JOIN airports d ON r.destination = d.iata_code
)"""


def _with_marts(select: str) -> str:
    return f"WITH {STAR},{MARTS}{select}"


def _sold(classes: str, continents: str = "origin_continent IS NOT NULL") -> str:
    """CTE ``sold``: a row per route that passes both filters."""
    return f""",
sold AS (
  SELECT * FROM (
    SELECT route_code, sum(ticket_count) AS ticket_count, coalesce(sum(revenue), 0) AS revenue
    FROM route_class WHERE class IN ({classes}) GROUP BY route_code
  ) JOIN network USING (route_code)
  WHERE {continents}
)"""


ALL = "'E', 'P', 'B'"

_CABIN = "CASE class WHEN 'E' THEN 'Economy' WHEN 'P' THEN 'Premium' WHEN 'B' THEN 'Business' ELSE class END"
_ROUTE_LABEL = "coalesce(origin_city, route_code) || ' → ' || coalesce(dest_city, '?')"


def _top_routes(classes: str, continents: str, n: int) -> str:
    return _with_marts(
        _sold(classes, continents)
        + f"""
SELECT route_code, CAST(ticket_count AS BIGINT) AS ticket_count, CAST(revenue AS DOUBLE) AS revenue,
       CAST(revenue AS DOUBLE) / ticket_count AS avg_ticket_value,
       origin_city, dest_city, origin_continent, CAST(distance AS DOUBLE) AS distance,
       {_ROUTE_LABEL} AS route_label
FROM sold ORDER BY sold.revenue DESC, route_code LIMIT {n}"""
    )


def _class_revenue(extra: str = "") -> str:
    return _with_marts(
        f"""
SELECT class, CAST(sum(ticket_count) AS BIGINT) AS ticket_count,
       CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue, {_CABIN} AS cabin_class{extra}
FROM route_class WHERE class IN ({ALL}) GROUP BY class ORDER BY revenue DESC, class"""
    )


def _monthly_trend(where: str) -> str:
    return _with_marts(
        f"""
SELECT year, month, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue,
       CAST(sum(ticket_count) AS BIGINT) AS ticket_count, make_date(year, month, 1) AS date
FROM monthly WHERE {where} GROUP BY year, month ORDER BY year, month"""
    )


def _monthly_by_class(where: str) -> str:
    return _with_marts(
        f"""
SELECT year, month, class, CAST(ticket_count AS BIGINT) AS ticket_count,
       CAST(revenue AS DOUBLE) AS revenue, {_CABIN} AS cabin_class,
       make_date(year, month, 1) AS date
FROM monthly WHERE {where} ORDER BY year, month, class"""
    )


def _kpi_totals(classes: str, continents: str = "origin_continent IS NOT NULL") -> str:
    return _with_marts(
        _sold(classes, continents)
        + """
SELECT CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS total_revenue,
       CAST(coalesce(sum(ticket_count), 0) AS BIGINT) AS total_tickets,
       coalesce(CAST(sum(revenue) AS DOUBLE) / nullif(CAST(sum(ticket_count) AS DOUBLE), 0), 0.0) AS avg_ticket,
       count(DISTINCT route_code) AS active_routes
FROM sold"""
    )


_REGIONS = """
regions AS (
  SELECT origin_continent, dest_continent, sum(ticket_count) AS ticket_count,
         sum(revenue) AS revenue, count(DISTINCT route_code) AS route_count,
         CAST(sum(distance) AS DOUBLE) / nullif(count(distance), 0) AS avg_distance
  FROM sold GROUP BY origin_continent, dest_continent
)"""


def _regional_revenue(continents: str) -> str:
    return _with_marts(
        _sold(ALL, continents)
        + f",{_REGIONS}"
        + """
SELECT origin_continent, dest_continent,
       origin_continent || ' → ' || coalesce(dest_continent, 'Unknown') AS region_pair,
       CAST(ticket_count AS BIGINT) AS ticket_count, CAST(revenue AS DOUBLE) AS revenue,
       route_count, avg_distance, CAST(revenue AS DOUBLE) / ticket_count AS avg_ticket_value,
       CAST(revenue AS DOUBLE) / nullif(CAST(sum(revenue) OVER () AS DOUBLE), 0) AS revenue_share
FROM regions ORDER BY regions.revenue DESC, origin_continent, dest_continent"""
    )


_CELLS = """
cells AS (
  SELECT o.origin_continent, d.dest_continent,
         CAST(coalesce(r.revenue, 0) AS DOUBLE) AS revenue
  FROM (SELECT DISTINCT origin_continent FROM regions) o
  CROSS JOIN (SELECT DISTINCT dest_continent FROM regions) d
  LEFT JOIN regions r ON o.origin_continent IS NOT DISTINCT FROM r.origin_continent
                     AND d.dest_continent IS NOT DISTINCT FROM r.dest_continent
)"""


def _matrix(select: str) -> str:
    return _with_marts(f"{_sold(ALL)},{_REGIONS},{_CELLS}{select}")


def _wide_column(name: str) -> str:
    return (
        f"coalesce(max(revenue) FILTER (WHERE coalesce(dest_continent, 'Unknown') = '{name}'), 0.0)"
        f' AS "{name}"'
    )


_DESTINATIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "Unknown"]

ORACLE_SQL = {
    "mart_route_class": _with_marts(
        """
SELECT route_code, class, ticket_count, CAST(revenue AS DOUBLE) AS revenue, avg_ticket_value,
       CAST(total_airport_tax AS DOUBLE) AS total_airport_tax,
       CAST(total_local_tax AS DOUBLE) AS total_local_tax
FROM route_class"""
    ),
    "mart_monthly": _with_marts(
        """
SELECT year, month, class, ticket_count, CAST(revenue AS DOUBLE) AS revenue
FROM monthly ORDER BY year, month, class"""
    ),
    "mart_routes_airports": _with_marts(
        """
SELECT route_code, origin, destination, parent_route, leg_number,
       CAST(distance AS DOUBLE) AS distance, flight_minutes,
       origin_airport, origin_city, origin_country, origin_continent,
       CAST(origin_lat AS DOUBLE) AS origin_lat, CAST(origin_lon AS DOUBLE) AS origin_lon,
       CAST(origin_tax AS DOUBLE) AS origin_tax,
       dest_airport, dest_city, dest_country, dest_continent,
       CAST(dest_lat AS DOUBLE) AS dest_lat, CAST(dest_lon AS DOUBLE) AS dest_lon,
       CAST(dest_tax AS DOUBLE) AS dest_tax
FROM network"""
    ),
    "mart_refresh": _with_marts(
        """
SELECT 'routes_with_airports' AS mart, count(*) AS rows, 'written' AS status,
       CAST(NULL AS VARCHAR) AS error FROM network
UNION ALL
SELECT 'revenue_by_route_class', count(*), 'written', NULL FROM route_class
UNION ALL
SELECT 'monthly_revenue', count(*), 'written', NULL FROM monthly"""
    ),
    "top_routes": _top_routes(ALL, "origin_continent IS NOT NULL", 15),
    "top_routes_filtered": _top_routes("'E', 'B'", "origin_continent IN ('ASIA', 'EUROPE')", 5),
    "class_revenue": _class_revenue(),
    "class_revenue_share": _class_revenue(
        ",\n       CAST(coalesce(sum(revenue), 0) AS DOUBLE)"
        " / nullif(CAST(sum(sum(revenue)) OVER () AS DOUBLE), 0) AS revenue_share"
    ),
    "monthly_trend": _monthly_trend(f"class IN ({ALL})"),
    "monthly_trend_year": _monthly_trend(f"class IN ({ALL}) AND year = 1998"),
    "monthly_by_class": _monthly_by_class(f"class IN ({ALL})"),
    "monthly_by_class_year": _monthly_by_class("class = 'E' AND year = 1998"),
    "continent_revenue": _with_marts(
        _sold("'E', 'P'")
        + """
SELECT origin_continent, CAST(sum(revenue) AS DOUBLE) AS revenue,
       CAST(sum(ticket_count) AS BIGINT) AS ticket_count
FROM sold GROUP BY origin_continent ORDER BY revenue DESC, origin_continent"""
    ),
    "route_efficiency": _with_marts(
        _sold(ALL)
        + f"""
SELECT route_code, CAST(ticket_count AS BIGINT) AS ticket_count, CAST(revenue AS DOUBLE) AS revenue,
       origin_city, dest_city, origin_continent, CAST(distance AS DOUBLE) AS distance,
       CAST(revenue AS DOUBLE) / CAST(distance AS DOUBLE) AS revenue_per_km,
       {_ROUTE_LABEL} AS route_label
FROM sold WHERE distance > 0 ORDER BY revenue_per_km DESC, route_code LIMIT 15"""
    ),
    "airport_revenue": _with_marts(
        _sold(ALL)
        + """
SELECT origin, any_value(origin_airport) AS origin_airport, any_value(origin_city) AS origin_city,
       any_value(origin_continent) AS origin_continent,
       CAST(any_value(origin_lat) AS DOUBLE) AS origin_lat,
       CAST(any_value(origin_lon) AS DOUBLE) AS origin_lon,
       CAST(sum(ticket_count) AS BIGINT) AS ticket_count, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM sold GROUP BY origin
HAVING any_value(origin_lat) IS NOT NULL AND any_value(origin_lon) IS NOT NULL
ORDER BY revenue DESC, origin"""
    ),
    "kpi_totals": _kpi_totals(ALL),
    "kpi_totals_no_match": _kpi_totals(ALL, "origin_continent IN ('ATLANTIS')"),
    "regional_revenue": _regional_revenue("origin_continent IN ('AFRICA', 'ASIA', 'EUROPE')"),
    "regional_revenue_from_marts": _regional_revenue("origin_continent IS NOT NULL"),
    "region_matrix_long": _matrix(
        """
SELECT origin_continent, dest_continent, revenue,
       '$' || CASE WHEN abs(revenue) >= 1e9 THEN format('{:.1f}B', revenue / 1e9)
                   WHEN abs(revenue) >= 1e6 THEN format('{:.1f}M', revenue / 1e6)
                   WHEN abs(revenue) >= 1e3 THEN format('{:.1f}K', revenue / 1e3)
                   ELSE format('{:.0f}', revenue) END AS label
FROM cells ORDER BY origin_continent, dest_continent"""
    ),
    "region_matrix_wide": _matrix(
        f"""
SELECT origin_continent, {", ".join(map(_wide_column, _DESTINATIONS))}
FROM cells GROUP BY origin_continent ORDER BY origin_continent"""
    ),
    "list_continents": _with_marts(
        """
SELECT DISTINCT origin_continent FROM network
WHERE origin_continent IS NOT NULL ORDER BY origin_continent"""
    ),
    "list_years": _with_marts("\nSELECT DISTINCT year FROM monthly ORDER BY year"),
    "source_stats": _with_marts(
        """
SELECT (SELECT count(DISTINCT route_code) FROM network) AS routes,
       (SELECT count(*) FROM (SELECT origin FROM network UNION SELECT destination FROM network)) AS airports,
       (SELECT CAST(sum(ticket_count) AS BIGINT) FROM route_class) AS tickets,
       (SELECT count(DISTINCT origin_country) FROM network) AS countries,
       (SELECT min(year) FROM monthly) AS year_min,
       (SELECT max(year) FROM monthly) AS year_max"""
    ),
    "csv_export": _monthly_trend(f"class IN ({ALL})"),
}

# The same answers by way of files.
ORACLE_SQL |= {
    "csv_top_routes": ORACLE_SQL["top_routes"],
    "csv_airports": ORACLE_SQL["airport_revenue"],
    "csv_regions": _regional_revenue("origin_continent IS NOT NULL"),
    "monthly_trend_year_from_marts": ORACLE_SQL["monthly_trend_year"],
}

# Answers of one report: the name of each, and what its rows are about.
_REPORT = {
    "class_revenue": "class",
    "airport_revenue": "origin",
    "top_routes": "route_code",
    "monthly_trend": "year || '-' || month",
    "csv_regions": "region_pair",
}
ORACLE_SQL["report_from_marts"] = "\nUNION ALL\n".join(
    f"SELECT '{name.replace('csv_regions', 'regional_revenue')}' AS answer, {about} AS about,"
    f" ticket_count, revenue FROM ({ORACLE_SQL[name]})"
    for name, about in _REPORT.items()
)

# Tickets that come in two deliveries give the answers of all tickets.
ORACLE_SQL["monthly_trend_after_new_files"] = ORACLE_SQL["monthly_trend"]
ORACLE_SQL["top_routes_after_new_files"] = ORACLE_SQL["top_routes"]

ORACLE_SQL["regional_revenue_from_buckets"] = ORACLE_SQL["regional_revenue_from_marts"]

ORACLE_SQL["rejected_tickets"] = """
WITH lines AS (
  SELECT l_extendedprice * (1 - l_discount) AS amount, l_linenumber,
         CASE WHEN l_quantity <> 50 THEN l_tax / (l_quantity - 50) END AS tax
  FROM lineitem),
faults AS (
  SELECT 'total_amount' AS source_column, 'not exact' AS reason FROM lines
  WHERE CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE) <> amount
  UNION ALL
  SELECT 'airport_tax', 'not a decimal(12,2)' FROM lines WHERE l_linenumber = 7
  UNION ALL
  SELECT 'local_tax', 'not exact' FROM lines WHERE CAST(CAST(tax AS DECIMAL(18,2)) AS DOUBLE) <> tax)
SELECT 'tickets' AS source_table, source_column, reason, count(*) AS rows
FROM faults GROUP BY ALL"""
