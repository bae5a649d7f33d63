"""Written tables are gone when the driver ends, also where it stopped the session itself."""

import subprocess
import sys

import pytest

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from assaykit.session import cut_lineage
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
assert cut_lineage(spark.range(10)).count() == 10
if sys.argv[2] == "stop":
    spark.stop()
"""


@pytest.mark.parametrize("end", ["stop", "exit"])
def test_nothing_is_left(tmp_path, end):
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), end], check=True, timeout=120)
    assert not [p for p in tmp_path.rglob("rows-*")]
