"""Column expressions against plain Python, value by value."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.labels import cabin_label, compact_money
from skyledger.functions.measures import exact_sum, mean, month_start, ratio

SLOW = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def apply(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in frame.select("i", expression(F.col("v")).alias("out")).sort("i").collect()]


@pytest.mark.parametrize(
    ("amount", "label"),
    [
        (0.0, "$0"),
        (0.5, "$0"),
        (1.5, "$2"),
        (-0.6, "$-1"),
        (999.0, "$999"),
        (999.6, "$1,000"),
        (1e3, "$1.0K"),
        (1234.5, "$1.2K"),
        (-1250.0, "$-1.2K"),
        (999_949.0, "$999.9K"),
        (999_999.0, "$1000.0K"),
        (1e6, "$1.0M"),
        (-2.5e6, "$-2.5M"),
        (999_999_999.0, "$1000.0M"),
        (1e9, "$1.0B"),
        (2.35e12, "$2350.0B"),
        (None, None),
    ],
)
def test_compact_money(spark, amount, label):
    assert apply(spark, [amount], "double", compact_money) == [label]


@SLOW
@given(st.lists(st.floats(-1e13, 1e13).map(lambda x: round(x, 2)), min_size=1, max_size=60))
def test_compact_money_rounds_the_exact_value_half_to_even(spark, amounts):
    def tenths(amount):
        units = [u for u in (1e9, 1e6, 1e3) if abs(amount) >= u]
        if not units:
            return None
        return Decimal(amount / units[0]).quantize(Decimal("0.1"), ROUND_HALF_EVEN)

    labels = apply(spark, amounts, "double", compact_money)
    for amount, label in zip(amounts, labels, strict=True):
        if tenths(amount) is not None:
            assert Decimal(label[1:-1]) == tenths(amount)


def test_cabin_label(spark):
    assert apply(spark, ["E", "P", "B", "X", "", None], "string", cabin_label) == [
        "Economy",
        "Premium",
        "Business",
        "X",
        "",
        None,
    ]


def test_ratio_of_zero_or_null_is_null(spark):
    frame = spark.createDataFrame([(1, 4), (1, 0), (None, 4), (0, 0)], "a int, b int")
    found = [r[0] for r in frame.select(ratio(F.col("a"), F.col("b"))).collect()]
    assert found == [0.25, None, None, None]


def test_mean_skips_nulls(spark):
    frame = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    assert frame.agg(mean(F.col("v"))).first()[0] == 1.5
    assert frame.filter("v > 5").agg(mean(F.col("v"))).first()[0] is None


def test_month_start_of_an_unknown_part_is_null(spark):
    frame = spark.createDataFrame([(2020, 2), (None, 2), (2020, None)], "y int, m int")
    found = [str(r[0]) for r in frame.select(month_start(F.col("y"), F.col("m"))).collect()]
    assert found == ["2020-02-01", "None", "None"]


@SLOW
@given(
    st.lists(
        st.tuples(
            st.sampled_from("xyz"),
            st.none() | st.decimals(-9_999_999_999, 9_999_999_999, places=2),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_exact_sum_is_the_plain_sum(spark, pairs):
    frame = spark.createDataFrame(pairs, "k string, v decimal(12,2)")
    both = frame.groupBy("k").agg(F.sum("v").alias("plain"), exact_sum(frame, "v").alias("words"))
    assert both.schema["words"].dataType == both.schema["plain"].dataType
    for row in both.collect():
        assert row.words == row.plain


@pytest.mark.parametrize("scale", [0, 1, 2, 6, 12])
def test_every_digit_survives_the_way_through_a_double(spark, scale):
    """One row per group: the sum is the value, at the ends and at random places."""
    pick = random.Random(scale)
    units = [0, 1, -1, 10**12 - 1, 1 - 10**12, (1 << 20) - 1, 1 << 20, -(1 << 20)]
    units += [pick.randrange(1 - 10**12, 10**12) for _ in range(20_000)]
    values = [Decimal(u).scaleb(-scale) for u in units]
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.DecimalType(12, scale))])
    frame = spark.createDataFrame(list(enumerate(values)), schema)
    wrong = frame.groupBy("k").agg(F.sum("v").alias("plain"), exact_sum(frame, "v").alias("words"))
    assert wrong.filter("plain <> words").count() == 0


@pytest.mark.parametrize("scale", [0, 3, 12])
def test_exact_sum_at_other_scales(spark, scale):
    kind = T.DecimalType(12, scale)
    top = Decimal(10**12 - 1).scaleb(-scale)
    frame = spark.createDataFrame([(top,), (top,), (-top,), (None,)], T.StructType([T.StructField("v", kind)]))
    assert frame.agg(exact_sum(frame, "v")).first()[0] == top


def test_exact_sum_passes_other_types_to_the_plain_sum(spark):
    for kind, value in (("decimal(20,4)", Decimal("0.0001")), ("double", 0.5), ("bigint", 3)):
        frame = spark.createDataFrame([(value,), (value,)], f"v {kind}")
        assert frame.agg(exact_sum(frame, "v")).first()[0] == value * 2
