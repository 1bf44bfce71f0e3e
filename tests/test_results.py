import pytest

from tidemill.errors import UnknownName
from tidemill.functions.results import chart_series, column_count, describe_query, rows_as_text


def test_rows_as_text(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b, true AS c, DATE'2024-01-02' AS d, 1.50 AS e, array(1, 2) AS f, 'x' AS `odd.name`")
    assert tuple(rows_as_text(df).first()) == ("1", "NULL", "true", "2024-01-02", "1.50", "[1, 2]", "x")
    assert rows_as_text(df.where("false")).collect() == []
    assert column_count(df) == 7 and column_count(df.where("false")) == 0


def test_literal_select(spark):
    assert spark.sql("SELECT 1 AS one, 'a' AS letter").collect() == [(1, "a")]


def test_describe(spark):
    rows = describe_query(spark.sql("SELECT 1 AS a, 'x' AS b")).collect()
    assert [tuple(r) for r in rows] == [(1, "a", "int"), (2, "b", "string")]


@pytest.mark.parametrize(
    "cell, value, text",
    [
        ("'12.5'", 12.5, None), ("'1e3'", 1000.0, None), ("'-.5'", -0.5, None), ("'+3.'", 3.0, None),
        ("'abc'", None, "abc"), ("' 1'", None, " 1"), ("'1d'", None, "1d"), ("''", None, ""),
        ("'NaN'", 0.0, None), ("'-inf'", 0.0, None), ("'Infinity'", 0.0, None), ("'1e999'", 0.0, None),
        ("CAST('NaN' AS DOUBLE)", 0.0, None), ("CAST(NULL AS DOUBLE)", None, "NULL"), ("1.0E20D", 1e20, None),
        ("7", 7.0, None), ("true", None, "true"), ("DATE'2024-01-01'", None, "2024-01-01"),
    ],
)
def test_chart_values(spark, cell, value, text):
    row = chart_series(spark.sql(f"SELECT 'l' AS x, {cell} AS y"), "x", "y").first()
    assert tuple(row) == ("l", value, text)


def test_chart_labels_order_and_missing_column(spark):
    df = spark.sql("SELECT * FROM VALUES (3, 1), (CAST(NULL AS INT), 2), (1, 3) AS t(x, y) ORDER BY y DESC")
    assert [r.label for r in chart_series(df, "x", "y").collect()] == ["1", "NULL", "3"]
    with pytest.raises(UnknownName):
        chart_series(df, "x", "z")
