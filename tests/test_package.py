"""The package on executors that don't have it, and keys beyond 32 bits."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from headway.operators import dims
from headway.operators.lines import line_membership

REPO = Path(__file__).parent.parent

FIT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from headway.model import session
from headway.operators.positions import fit_paths
spark = session("fresh", "local[1]", **{{"spark.ui.enabled": "false"}})
points = [(float(i), float(i * i)) for i in range(6)]
paths = spark.createDataFrame([(1, 2, points)], "from_st int, to_st int, points array<struct<lat double, lon double>>")
print("BENDS", [round(x, 9) for x in fit_paths(paths).first().lon_bend])
"""


def test_executors_get_the_code(tmp_path):
    """In a process whose working folder isn't the repository, workers find the package only if it is sent."""
    done = subprocess.run([sys.executable, "-c", FIT], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "BENDS [2.0, 2.0, 2.0, 2.0, 2.0, 2.0]" in done.stdout, done.stderr[-2000:]


def test_keys_above_32_bits(spark):
    large = 1 << 40
    dim = spark.createDataFrame([(large, "A")], "station long, label string")
    assert dims.upsert(dim, spark.createDataFrame([(large, "B")], "station long, label string"), "station").first().label == "B"
    stretches = spark.createDataFrame([(1, 0, ["a", "b"])], "line long, seq int, labels array<string>")
    assert line_membership(stretches).schema["pos"].dataType.simpleString() == "bigint"
    assert line_membership(stretches.withColumn("line", F.lit(large))).first().line == large
