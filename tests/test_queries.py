import pytest
from compare import connect, differences
from conftest import DATA

from workloads import ORACLES, QUERIES

@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    assert differences(QUERIES[name](spark, DATA), db, ORACLES[name]) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
