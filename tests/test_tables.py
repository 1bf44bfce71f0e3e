import threading

import pytest

from tidemill import Column
from tidemill.errors import SpecError
from tidemill.plans import tables


@pytest.mark.parametrize("external", [False, True])
def test_create_replace_append_drop(spark, tmp_path, external):
    location = str(tmp_path) if external else None
    name = f"shop.t_{external}".lower()
    assert not tables.table_exists(spark, name)
    tables.create_or_replace(spark.range(3), name, location)
    assert tables.table_exists(spark, name) and spark.table(name).count() == 3
    again = spark.table(name).selectExpr("id + 10 AS id", "'x' AS note")
    tables.create_or_replace(again, name, location)
    assert sorted(map(tuple, spark.table(name).collect())) == [(10, "x"), (11, "x"), (12, "x")]
    tables.append_rows(spark.sql("SELECT 'y' AS note, 13L AS id"), name)
    assert spark.table(name).where("note = 'y'").collect() == [(13, "y")]
    assert [tuple(r) for r in tables.table_schema(spark, name).collect()] == [(1, "id", "bigint"), (2, "note", "string")]
    assert name.split(".")[1] in [r.table_name for r in tables.list_tables(spark, "t_*", "shop").collect()]
    tables.drop_table(spark, name)
    tables.drop_table(spark, name)
    assert not tables.table_exists(spark, name)


@pytest.mark.parametrize("keep, versions", [(False, 1), (True, 2)])
def test_replaced_versions(spark, tmp_path, keep, versions):
    place = tmp_path / "store"
    for round_ in range(2):
        tables.create_or_replace(spark.range(round_ + 1), "versioned", str(place), keep_replaced=keep)
    assert spark.table("versioned").count() == 2
    assert len(list(place.iterdir())) == versions
    tables.create_or_replace(spark.range(5), "versioned", str(tmp_path / "elsewhere"))
    assert len(list(place.iterdir())) == versions
    tables.drop_table(spark, "versioned")


def test_failed_write_leaves_the_table_alone(spark):
    tables.create_or_replace(spark.range(2), "steady")
    with pytest.raises(Exception):
        tables.create_or_replace(spark.sql("SELECT raise_error('no') AS id"), "steady")
    assert spark.table("steady").count() == 2


def test_empty_table(spark):
    created = tables.create_empty(spark, "blank", [Column("id", "INTEGER"), Column("name", "STRING")])
    assert created.count() == 0 and created.columns == ["id", "name"]
    with pytest.raises(SpecError):
        tables.create_empty(spark, "blank", [])


def test_scratch_names_differ():
    assert tables.scratch_name("x") != tables.scratch_name("x")


def test_a_database_lies_below_the_store_whichever_table_comes_first(spark, tmp_path):
    for name in ("zz.second", "zz.first"):
        tables.create_or_replace(spark.range(1), name, str(tmp_path / "store" / name))
    where = spark.sql("DESCRIBE DATABASE zz").where("info_name = 'Location'").first()[1]
    assert where.endswith("/store/zz.db")
    assert tables.list_tables(spark, "fir'st*", "zz").count() == 0
    spark.sql("DROP DATABASE zz CASCADE")


def test_a_reader_never_misses_a_table_that_is_replaced(spark, tmp_path):
    place, seen, stop = str(tmp_path / "pointer"), [], threading.Event()
    version = lambda n: spark.range(100 * n, 100 * n + 100)
    tables.create_or_replace(version(0), "moved_at_once", place, keep_replaced=True)

    def read():
        while not stop.is_set():
            try:
                low, high, n = spark.table("moved_at_once").selectExpr("min(id)", "max(id)", "count(*)").first()
                seen.append((low % 100, high - low, n))
            except Exception as error:  # noqa: BLE001 - the test looks at it
                seen.append(error)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 8):
        tables.create_or_replace(version(n), "moved_at_once", place, keep_replaced=True)
    stop.set()
    reader.join()
    assert set(seen) == {(0, 99, 100)} and spark.table("moved_at_once").first().id >= 700
    again = spark.table("moved_at_once").where("id < 750")
    assert tables.create_or_replace(again, "moved_at_once", place).count() == 50
    assert tables.create_or_replace(spark.range(3).withColumnRenamed("id", "other"), "moved_at_once", place).columns == ["other"]
    tables.drop_table(spark, "moved_at_once")
