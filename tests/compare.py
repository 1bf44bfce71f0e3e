"""Row comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET enable_progress_bar = false")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def differences(df, db, sql):
    """None when columns and rows agree exactly, a description otherwise."""
    cursor = db.execute(sql)
    theirs = [c[0] for c in cursor.description]
    if sorted(df.columns) != sorted(theirs):
        return f"columns {sorted(df.columns)} != {sorted(theirs)}"
    order = sorted(theirs)
    want = sorted(repr(tuple(dict(zip(theirs, row))[c] for c in order)) for row in cursor.fetchall())
    got = sorted(repr(tuple(row[c] for c in order)) for row in df.collect())
    if got == want:
        return None
    only_ours, only_theirs = _minus(got, want), _minus(want, got)
    return f"{len(got)} rows, expected {len(want)}; ours only {only_ours[:3]}; theirs only {only_theirs[:3]}"


def _minus(a, b):
    from collections import Counter

    return list((Counter(a) - Counter(b)).elements())
