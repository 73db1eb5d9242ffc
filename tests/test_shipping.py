"""The package reaches Python workers that are started elsewhere."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from spillway import compile_job, parse, register_function, ship
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from spillway.functions import semantics
ship(spark)
ship(spark)
print("found", spark.range(2).rdd.map(lambda _: __import__("spillway.functions.semantics").__name__).collect())
"""


def test_ship(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO))], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "found ['spillway', 'spillway']" in done.stdout, done.stderr[-2000:]
