"""The package reaches the executors from wherever the driver was started."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from tabloom.session import local_session, ship_code
from tabloom.operators.isolation import IsolationForest
spark = local_session(2, 2, "1g")
assert ship_code(spark) == ship_code(spark)
df = spark.range(40).select("id", F.array(F.col("id").cast("double")).alias("v"))
print("ROWS", IsolationForest.fit(df, F.col("v"), F.col("id"), n_trees=5).score(df, F.col("v")).count())
"""


def test_started_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, repo], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=200)
    assert "ROWS 40" in done.stdout, done.stderr[-2000:]
