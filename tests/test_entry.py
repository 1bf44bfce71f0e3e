import os
import subprocess
import sys
import textwrap
from pathlib import Path

from conftest import DATA

import __spark_entry__ as entry_points

REPO = Path(entry_points.__file__).parent


def test_contract():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 70


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert 0 < len(rows) <= 10 and rows[0].days >= rows[-1].days


def test_workers_get_the_code_when_the_session_runs_elsewhere(tmp_path):
    script = f"""
        import sys
        sys.path.insert(0, {str(REPO)!r})
        import __spark_entry__
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        for name in ("sqlite_scan", "json_scan"):
            print(name, __spark_entry__.queries()[name](spark, {DATA!r}).count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split("\n")[-3:-1] == ["sqlite_scan 200", "json_scan 1000"], done.stderr[-2000:]
