"""Workers that know no folder of the driver's still find the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from spanlake.shipping import ship
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
ship(spark)

def run(batches):
    import pyarrow as pa
    from spanlake.operators.spec import Bounds
    import spanlake
    for b in batches:
        yield pa.RecordBatch.from_pylist([{{"at": spanlake.__file__, "start": Bounds("s", "e").start}}])

got = spark.range(4).repartition(4).mapInArrow(run, "at string, start string").collect()
assert got and all("spanlake.zip" in r["at"] and r.start == "s" for r in got), got
print("found")
"""


def test_workers_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "found" in got.stdout, got.stderr[-2000:]
