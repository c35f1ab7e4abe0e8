"""The driver contract works from a plain session started outside the repository
(Python workers must import the package for grouped-map fits)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
print("ROWS", E.queries()["m07_gamma_trend"](spark, "/root/testdata/sf0.001").count())
print("ENTRY", E.entry(spark).count())
"""


def test_grouped_map_query_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="vf-foreign-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                       timeout=600)
    lines = [l for l in r.stdout.splitlines() if l.startswith(("ROWS", "ENTRY"))]
    assert r.returncode == 0, r.stderr[-2000:]
    assert int(lines[0].split()[1]) > 0 and int(lines[1].split()[1]) > 0
