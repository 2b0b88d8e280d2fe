"""What a job writes goes with its session."""

import os
import re
import subprocess
import sys

RUN = """
import re, sys, os
from pyspark.sql import SparkSession
from tidelocus import scratch
from tidelocus.plans import files
session = lambda: SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
spark = session()
assert scratch.written(spark.range(5), "a").count() == 5
gone = scratch.written(spark.range(5), "b")
own = lambda: sorted(x[0] for x in os.listdir(sys.argv[1]) if re.fullmatch("[abc]-[0-9a-f]{32}", x))  # beside Spark's own folder
assert own() == ["a", "b"]
if sys.argv[2] == "again":
    spark.stop()
    spark = session()
    assert scratch.written(spark.range(3), "c").count() == 3
    assert own() == ["c"]
if sys.argv[2] == "killed":
    os._exit(1)
spark.stop()
"""


def test_folders_go(tmp_path):
    for how in ("stopped", "again", "killed"):
        top = tmp_path / how
        top.mkdir()
        done = subprocess.run([sys.executable, "-c", RUN, str(top), how], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=200, check=False)
        assert done.returncode == (1 if how == "killed" else 0), done.stderr[-2000:]
        left = lambda: [x for x in os.listdir(top) if re.fullmatch("[abc]-[0-9a-f]{32}", x)]  # noqa: B023, E731
        for _ in range(100):  # a killed driver's JVM ends a little later
            if left():
                subprocess.run(["sleep", "0.2"], check=True)
        assert left() == []
