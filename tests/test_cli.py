"""The command line runs the batch ingest end to end in a fresh process."""

import os
import subprocess
import sys

from vesselflow.sources.fixtures import zone_polygons

from .test_io import _files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_cli_ingest(spark, scratch):
    raw = os.path.join(scratch, "raw")
    _files(raw)
    polys = os.path.join(scratch, "polys")
    zone_polygons(spark).write.parquet(polys)
    out = os.path.join(scratch, "modelled")
    env = dict(os.environ, PYTHONPATH=ROOT)
    r = subprocess.run([sys.executable, "-m", "vesselflow", "--master", "local[2]", "ingest", "--raw", raw,
                        "--polygons", polys, "--out", out], cwd=scratch, env=env, capture_output=True, text=True,
                       timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    df = spark.read.parquet(out)
    assert df.count() == 5 and "vessel_state" in df.columns
