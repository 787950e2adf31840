"""CSV files of answers."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.plans.together import Failed, together
from skyledger.sources import files

# The answers offered for download, and the name of each file.
EXPORTS = {
    "top_routes": "top_routes.csv",
    "monthly_trend": "monthly_trend.csv",
    "airport_revenue": "revenue_by_airport.csv",
    "regional_revenue": "regional_revenue.csv",
}


def plain_number(column: Column) -> Column:
    """A double as text without an exponent: 1058306884.49 rather than 1.05830688449E9.

    Spark's own digits, which read back equal, with the point moved; NaN and infinity
    are their names.
    """
    text = column.cast("string")
    form = r"^(-?)(\d+)\.(\d+)E(-?\d+)$"
    sign, whole, after, power = (F.regexp_extract(text, form, k) for k in (1, 2, 3, 4))
    digits = F.concat(whole, F.when(after != "0", after).otherwise(F.lit("")))
    # Only where there is an exponent is there a power to read.
    shift = F.when(power != "", power).cast("int")
    padded = F.rpad(digits, F.greatest(F.length(digits), shift + 1), "0")
    rest = F.substring(padded, shift + 2, F.length(padded))
    large = F.concat(
        sign, F.substring(padded, F.lit(1), shift + 1), F.lit("."), F.when(rest != "", rest).otherwise(F.lit("0"))
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -shift - 1), digits)
    return F.when(power == "", text).when(shift >= 0, large).otherwise(small)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in the folder ``path``; nulls are empty fields.

    A quote inside text is doubled and blanks around it are kept.
    """
    columns = [
        plain_number(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    (
        df.select(*columns)
        .write.mode("overwrite")
        .option("header", True)
        .option("emptyValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_csv_file(df: DataFrame, path: str) -> None:
    """Write a small ``df`` as one CSV file of the name ``path``.

    One task writes it to a hidden folder beside ``path``; only when it is whole does it
    take the name, in one step, in place of what had it. A failure leaves that as it was.
    """
    spark = df.sparkSession
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        export_csv(df.coalesce(1), hidden)
        (part,) = [e.name for e in files.entries(spark, hidden) if e.name.startswith("part-")]
        files.move_over(spark, f"{hidden}/{part}", path)
    finally:
        files.remove(spark, hidden)


def export_report(answers: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """The downloadable answers, one file each, under ``folder``; returns the paths.

    The files are written at the same time, each by one task: the answers have a row per
    ranked route, calendar month, airport or pair of continents. If some fail, the others
    are there, and the first failure is raised.
    """
    paths = {answer: f"{folder}/{file_name}" for answer, file_name in EXPORTS.items()}
    jobs = {answer: partial(export_csv_file, answers[answer], path) for answer, path in paths.items()}
    for result in together(answers["top_routes"].sparkSession, jobs).values():
        if isinstance(result, Failed):
            raise result.cause
    return paths
