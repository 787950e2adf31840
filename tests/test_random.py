"""All questions on random rows with many nulls, orphans and ties, against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime
from fractions import Fraction

import pytest

import skyledger as sl
from tests.conftest import dicts

CABINS = {"E": "Economy", "P": "Premium", "B": "Business"}


class World:
    """Random rows, and the answers worked out row by row in exact fractions."""

    def __init__(self, seed: int):
        pick = random.Random(seed)
        continents = ["ASIA", "EUROPE", "AFRICA", None]
        self.airports = [
            (
                f"A{i}",
                pick.choice([f"City {i}", f"City {i}", None]),
                pick.choice(continents),
                pick.choice([i, i, None]),
                pick.choice([-i, -i, None]),
            )
            for i in range(9)
        ]
        codes = [a[0] for a in self.airports] + ["A?"]
        self.routes = [
            (f"R{i}", pick.choice(codes), pick.choice(codes), pick.choice([0, None, 100, 250.5, 999]))
            for i in range(25)
        ]
        self.tickets = [
            (
                pick.choice([r[0] for r in self.routes] + ["lost", None]),
                pick.choice(["E", "E", "P", "B", "X", None]),
                pick.choice([None, 1, 1, 2.5, 10.25, 999.99, -3]),
                pick.choice([None, datetime(2019, pick.randint(1, 3), 5), datetime(2020, 1, 1)]),
            )
            for _ in range(400)
        ]
        by_code = {a[0]: a for a in self.airports}
        self.network = {
            code: (by_code[o], by_code[d], km)
            for code, o, d, km in self.routes
            if o in by_code and d in by_code
        }

    @staticmethod
    def sums(tickets, key):
        groups = defaultdict(lambda: [0, Fraction(0)])
        for ticket in tickets:
            group = groups[key(ticket)]
            group[0] += 1
            group[1] += Fraction(str(ticket[2] or 0))
        return groups

    def of_classes(self, spec):
        return [t for t in self.tickets if t[1] in spec.classes]

    def passing(self, spec):
        """Tickets of the classes on known routes from a continent that passes."""

        def passes(code):
            if code not in self.network:
                return False
            origin = self.network[code][0][2]
            return origin is not None and (spec.continents is None or origin in spec.continents)

        return [t for t in self.of_classes(spec) if passes(t[0])]


def close(found, wanted):
    assert len(found) == len(wanted)
    for row, expected in zip(found, wanted, strict=True):
        for key, value in expected.items():
            if isinstance(value, Fraction):
                assert row[key] == pytest.approx(float(value), rel=1e-12, abs=1e-12), (key, row)
            else:
                assert row[key] == value, (key, row)


def null_first(*values):
    return [(v is not None, v if v is not None else "") for v in values]


SPECS = [
    sl.FilterSpec(),
    sl.FilterSpec(classes=("E", "X"), continents=("ASIA", "AFRICA"), year=2019, top_n=4),
]


@pytest.mark.parametrize("spec", SPECS, ids=["all", "narrow"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_questions_on_random_rows(edge, seed, spec):
    world = World(seed)
    marts = edge(world.tickets, world.routes, world.airports)

    def label(code):
        origin, destination, _ = world.network[code]
        return f"{origin[1] or code} → {destination[1] or '?'}"

    routes = world.sums(world.passing(spec), lambda t: t[0])
    ranked = sorted(routes.items(), key=lambda item: (-item[1][1], item[0]))
    close(
        dicts(sl.top_routes(marts, spec)),
        [
            {
                "route_code": code,
                "ticket_count": n,
                "revenue": amount,
                "avg_ticket_value": amount / n,
                "route_label": label(code),
                "origin_continent": world.network[code][0][2],
            }
            for code, (n, amount) in ranked[: spec.top_n]
        ],
    )

    flown = [(c, n, a, Fraction(str(world.network[c][2]))) for c, (n, a) in routes.items() if world.network[c][2]]
    flown.sort(key=lambda r: (-float(r[2]) / float(r[3]), r[0]))
    close(
        dicts(sl.route_efficiency(marts, spec)),
        [
            {"route_code": c, "revenue": a, "revenue_per_km": a / km, "route_label": label(c)}
            for c, n, a, km in flown[: spec.top_n]
        ],
    )

    classes = world.sums(world.of_classes(spec), lambda t: t[1])
    whole = sum(a for _, a in classes.values())
    close(
        dicts(sl.class_revenue_share(marts, spec)),
        [
            {
                "class": c,
                "cabin_class": CABINS.get(c, c),
                "ticket_count": n,
                "revenue": a,
                "revenue_share": a / whole,
            }
            for c, (n, a) in sorted(classes.items(), key=lambda item: (-item[1][1], item[0]))
        ],
    )

    def month(ticket):
        return (ticket[3].year, ticket[3].month) if ticket[3] else (None, None)

    in_year = [t for t in world.of_classes(spec) if spec.year in (None, month(t)[0])]
    months = world.sums(in_year, month)
    close(
        dicts(sl.monthly_trend(marts, spec)),
        [
            {
                "year": y,
                "month": m,
                "revenue": months[y, m][1],
                "ticket_count": months[y, m][0],
                "date": date(y, m, 1) if y else None,
            }
            for y, m in sorted(months, key=lambda ym: null_first(*ym))
        ],
    )
    split = world.sums(in_year, lambda t: (*month(t), t[1]))
    close(
        dicts(sl.monthly_by_class(marts, spec)),
        [
            {"year": k[0], "month": k[1], "class": k[2], "ticket_count": split[k][0]}
            for k in sorted(split, key=lambda k: null_first(*k))
        ],
    )

    every_continent = sl.FilterSpec(classes=spec.classes)
    continents = world.sums(world.passing(every_continent), lambda t: world.network[t[0]][0][2])
    close(
        dicts(sl.continent_revenue(marts, spec)),
        [
            {"origin_continent": c, "revenue": a, "ticket_count": n}
            for c, (n, a) in sorted(continents.items(), key=lambda item: (-item[1][1], item[0]))
        ],
    )

    airports = world.sums(world.passing(spec), lambda t: world.network[t[0]][0])
    placed = [(a, v) for a, v in airports.items() if a[3] is not None and a[4] is not None]
    close(
        dicts(sl.airport_revenue(marts, spec)),
        [
            {"origin": a[0], "origin_city": a[1], "origin_lat": a[3], "ticket_count": n, "revenue": r}
            for a, (n, r) in sorted(placed, key=lambda item: (-item[1][1], item[0][0]))
        ],
    )

    tickets = world.passing(spec)
    revenue = sum((a for _, a in routes.values()), Fraction(0))
    close(
        dicts(sl.kpi_totals(marts, spec)),
        [
            {
                "total_revenue": revenue,
                "total_tickets": len(tickets),
                "avg_ticket": revenue / len(tickets),
                "active_routes": len(routes),
            }
        ],
    )

    def pair(code):
        return world.network[code][0][2], world.network[code][1][2]

    regions = world.sums(tickets, lambda t: pair(t[0]))
    wanted = []
    for (o, d), (n, a) in sorted(
        regions.items(), key=lambda item: (-item[1][1], null_first(*item[0]))
    ):
        members = [c for c in routes if pair(c) == (o, d)]
        known = [Fraction(str(world.network[c][2])) for c in members if world.network[c][2] is not None]
        wanted.append(
            {
                "origin_continent": o,
                "dest_continent": d,
                "region_pair": f"{o} → {d or 'Unknown'}",
                "ticket_count": n,
                "revenue": a,
                "route_count": len(members),
                "avg_distance": sum(known) / len(known) if known else None,
                "avg_ticket_value": a / n,
                "revenue_share": a / revenue,
            }
        )
    frame = sl.regional_revenue(marts, spec)
    close(dicts(frame), wanted)

    axis_o = sorted({o for o, _ in regions})
    axis_d = sorted({d for _, d in regions}, key=null_first)
    close(
        dicts(sl.region_matrix(frame)),
        [
            {
                "origin_continent": o,
                "dest_continent": d,
                "revenue": regions[o, d][1] if (o, d) in regions else Fraction(0),
            }
            for o in axis_o
            for d in axis_d
        ],
    )
