"""Sketches beside exact counts: one of each for a type, also where types are null."""

import re

from workloads import QUERIES


def test_sketches_are_not_kept_for_each_user(spark, tmp_path):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN null ELSE concat('t', id % 3) END AS event_type", "id % 700 AS user_id", "id * 0.5D AS value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["approx_aggs"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"keys=\[([^\]]*)\], functions=\[[^\n]*(?:percentile_approx|approx_count_distinct)", plan)
    assert keys and not any("user_id" in k for k in keys)
    found = sorted((str(r.event_type), r.measure, r.within_bound) for r in got.collect())
    quantiles = [(t, m, True) for t in ("t1", "t2") for m in ("0.25", "0.5", "0.95", "users")]
    assert found == sorted([*quantiles, ("None", "users", True)])
