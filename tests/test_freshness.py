from datetime import datetime

from tidemill.operators.freshness import invalidate_downstream, oldest_input, upsert_freshness
from tidemill.operators.runs import completed_tasks, latest_run, phase_counts

FIELDS = "name string, updated_at timestamp_ntz"
JAN, FEB, MAR = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)


def as_dict(df):
    return dict(map(tuple, df.collect()))


def test_upsert(spark):
    existing = spark.createDataFrame([("a", JAN), ("b", FEB), ("c", None), ("d", MAR)], FIELDS)
    updates = spark.createDataFrame([("a", MAR), ("c", FEB), ("new", JAN), ("a", FEB), ("d", None)], FIELDS)
    assert as_dict(upsert_freshness(existing, updates)) == {"a": MAR, "b": FEB, "c": FEB, "d": None, "new": JAN}


def test_oldest_input_ignores_unknown_times(spark, pairs):
    nodes = spark.createDataFrame([("a", FEB), ("b", JAN), ("c", None)], FIELDS)
    edges = pairs(("a", "m"), ("b", "m"), ("c", "m"), ("c", "n"), ("a", "o"))
    assert as_dict(oldest_input(edges, nodes)) == {"m": JAN, "n": None, "o": FEB}


def test_invalidate_downstream(spark, pairs, names):
    nodes = spark.createDataFrame([(n, JAN) for n in "abcde"], FIELDS)
    edges = pairs(("a", "b"), ("b", "c"), ("e", "d"))
    assert as_dict(invalidate_downstream(nodes, edges, names("b"))) == {"a": JAN, "b": None, "c": None, "d": JAN, "e": JAN}


def test_run_log_questions(spark):
    fields = "run_id string, run_started_at timestamp_ntz, task string, phase string, completed_at timestamp_ntz"
    log = spark.createDataFrame(
        [
            ("r1", JAN, "a", "completed", JAN),
            ("r2", FEB, "a", "completed", MAR),
            ("r2", FEB, "b", "failed", MAR),
            ("r2", FEB, "c", "skipped", None),
        ],
        fields,
    )
    assert sorted(r.task for r in latest_run(log).collect()) == ["a", "b", "c"]
    assert sorted((r.run_id, r.task) for r in completed_tasks(log).collect()) == [("r1", "a"), ("r2", "a")]
    counts = {r.run_id: r.asDict() for r in phase_counts(log).collect()}
    assert (counts["r2"]["total"], counts["r2"]["completed"], counts["r2"]["skipped"], counts["r2"]["waiting"]) == (3, 1, 1, 0)
