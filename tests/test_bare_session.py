"""The streaming queries in a session that sets nothing: a process of its own, as the test session has every setting."""

import os
import subprocess
import sys

CODE = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
queries = entry.queries()
for name in sys.argv[1:]:
    print("rows", name, queries[name](spark, "/root/testdata/sf0.001").count())
assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
"""
STATEFUL = ["st01_live_timeline", "st05_live_book", "st06_next_trade", "st06_day_close", "st07_live_boxes", "st08_timed_checks"]


def test_stateful_queries_run_in_any_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CODE, *STATEFUL], cwd=root, capture_output=True, text=True, timeout=600,
                          env={**os.environ, "PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-3000:]
    rows = dict(line.split()[1:] for line in done.stdout.splitlines() if line.startswith("rows "))
    assert set(rows) == set(STATEFUL) and all(int(n) > 0 for n in rows.values())
