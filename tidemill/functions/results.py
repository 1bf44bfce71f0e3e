"""Shaping query results: text cells, column listings, chart series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import UnknownName
from tidemill.plans.tables import schema_rows

NULL_TEXT = "NULL"
# What counts as a number in a text cell, and the words for values without a place on an axis.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NOT_FINITE = r"^[+-]?(?i:inf|infinity|nan)$"


def rows_as_text(df: DataFrame) -> DataFrame:
    """Every cell as text, null as the word ``NULL``."""
    return df.select(*[F.coalesce(_text(f), F.lit(NULL_TEXT)).alias(f.name) for f in df.schema])


def column_count(df: DataFrame) -> int:
    """Columns of a result; a result without rows counts none."""
    return 0 if df.isEmpty() else len(df.columns)


def describe_query(df: DataFrame) -> DataFrame:
    """Column names and types; nothing is read."""
    return schema_rows(df)


def chart_series(df: DataFrame, x_column: str, y_column: str) -> DataFrame:
    """``(label, value, value_text)`` in the order of the query.

    The label is text. The value is a number where the cell holds one, 0 where it is not
    finite; any other cell is kept as text in ``value_text``.
    """
    fields = {f.name: f for f in df.schema}
    for column in (x_column, y_column):
        if column not in fields:
            raise UnknownName(f"the query has no column {column!r}")
    text = F.coalesce(_text(fields[y_column]), F.lit(NULL_TEXT))
    value = F.when(text.rlike(_NUMBER), text.try_cast("double")).when(text.rlike(_NOT_FINITE), F.lit(0.0))
    series = df.select(F.coalesce(_text(fields[x_column]), F.lit(NULL_TEXT)).alias("label"), value.alias("value"), text.alias("text"))
    finite = F.when(F.abs("value") == F.lit(float("inf")), F.lit(0.0)).otherwise(F.col("value"))
    return series.select(
        "label", finite.alias("value"), F.when(F.col("value").isNull(), F.col("text")).alias("value_text")
    )


def _text(field):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(column)
    return column.cast("string")
