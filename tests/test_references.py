import pytest

from tidemill.plans.references import reference_edges, referenced_tables
from tidemill.specs import Model

CASES = {
    "SELECT boat, sail FROM harbour": ["harbour"],
    "SELECT t.tide FROM tides AS t WHERE t.height BETWEEN 1 AND 2": ["tides"],
    "FROM tides SELECT tide": ["tides"],
    "SELECT h.boat FROM harbour h SEMI JOIN tides USING (day)": ["harbour", "tides"],
    "SELECT * FROM a, b": ["a", "b"],
    "SELECT * FROM a LEFT JOIN (b JOIN c ON b.x = c.x) ON a.x = b.x": ["a", "b", "c"],
    "SELECT * FROM marts.totals LIMIT 5": ["marts.totals"],
    "WITH d AS (SELECT * FROM logs) SELECT * FROM d": ["logs"],
    "WITH logs AS (SELECT * FROM logs) SELECT * FROM logs": ["logs"],
    "WITH d AS (SELECT * FROM a), e AS (SELECT * FROM d JOIN b) SELECT * FROM e JOIN c": ["a", "b", "c"],
    "SELECT * FROM a UNION ALL SELECT * FROM b": ["a", "b"],
    "SELECT * FROM (SELECT * FROM a WHERE x > 1) t": ["a"],
    "SELECT * FROM a WHERE x IN (SELECT x FROM b)": ["a", "b"],
    "SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.x = a.x)": ["a", "b"],
    "SELECT (SELECT max(x) FROM b) AS m FROM a": ["a", "b"],
    "SELECT * FROM a ORDER BY (SELECT max(x) FROM b)": ["a", "b"],
    "SELECT * FROM a JOIN LATERAL (SELECT * FROM b WHERE b.x = a.x) t": ["a", "b"],
    "SELECT x FROM a JOIN a b ON a.x = b.x": ["a"],
    "WITH RECURSIVE r(n) AS (SELECT n FROM s UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r": ["s"],
    "WITH d AS (SELECT 1 AS x) SELECT * FROM a WHERE x IN (SELECT x FROM d)": ["a"],
    "SELECT count(*) FILTER (WHERE x IN (SELECT x FROM b)) FROM a HAVING count(*) > (SELECT min(x) FROM c)": ["a", "b", "c"],
    "SELECT 1": [],
}


@pytest.mark.parametrize("sql", CASES)
def test_tables_of_a_query(spark, sql):
    assert sorted(referenced_tables(spark, sql)) == sorted(CASES[sql])


def test_edges_of_models(spark):
    models = [Model("m", "SELECT * FROM a JOIN b ON a.x = b.x"), Model("n", "SELECT * FROM m")]
    assert sorted(map(tuple, reference_edges(spark, models).collect())) == [("a", "m"), ("b", "m"), ("m", "n")]
