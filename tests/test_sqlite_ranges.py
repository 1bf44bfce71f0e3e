"""Several, sparse and key-ordered SQLite tables in ranges of bounded rows."""

import sqlite3
from contextlib import closing

import pytest

from tidemill.sources import sqlite, sqlite_ranges


@pytest.fixture
def files(tmp_path):
    """Two files: close row ids, and two crowds far apart; a table by key in both."""
    paths = [str(tmp_path / "near.db"), str(tmp_path / "far.db")]
    ids = [range(-5, 995), [*range(700), *range(10**15, 10**15 + 300), 2**63 - 1]]
    for number, (path, own) in enumerate(zip(paths, ids)):
        with closing(sqlite3.connect(path)) as db:
            db.execute("CREATE TABLE pots (id INTEGER PRIMARY KEY, glaze TEXT)")
            db.executemany("INSERT INTO pots VALUES (?, ?)", [(i, f"{number}:{i}") for i in own])
            db.execute('CREATE TABLE keyed (kind TEXT, "n o" INT, v REAL, PRIMARY KEY (kind, "n o")) WITHOUT ROWID')
            db.executemany("INSERT INTO keyed VALUES (?, ?, ?)", [(f"k{i % 3}", i * (number + 1), None if i % 7 else i / 2) for i in range(450)])
            db.execute("CREATE VIEW seen AS SELECT kind, v FROM keyed WHERE v IS NOT NULL")
            db.execute("CREATE TABLE bare (id INTEGER)")
            db.commit()
    return paths


@pytest.mark.parametrize("table", ["pots", "keyed", "bare"])
def test_all_rows_once_in_bounded_parts(spark, files, monkeypatch, table):
    monkeypatch.setattr(sqlite, "ROWS_PER_PARTITION", 100)
    want = []
    for path in files:
        with closing(sqlite3.connect(path)) as db:
            want += db.execute(f"SELECT * FROM {table}").fetchall()
    df = sqlite.read_sqlite(spark, files, table)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    ranges = sqlite_ranges.row_ranges(spark, files, table, 100).collect()
    assert all(0 < r.rows <= 100 for r in ranges)
    if want:
        assert len({r.path for r in ranges}) == 2 and df.rdd.getNumPartitions() >= len(want) // 100


def test_one_sparse_file(spark, files, monkeypatch):
    monkeypatch.setattr(sqlite, "ROWS_PER_PARTITION", 100)
    assert sqlite.read_sqlite(spark, files[1], "pots").count() == 1001
    assert sqlite.read_sqlite(spark, files[1], "keyed").where("kind = 'k1'").count() == 150
    assert sqlite.read_sqlite(spark, files, "seen").count() == 2 * 65
