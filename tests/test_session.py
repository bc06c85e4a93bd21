"""Sessions that configure nothing."""

import os
import subprocess
import sys

PLAIN = """
from pyspark.sql import SparkSession
from assay.operators.graph import connected_components
from assay.session import cut, shared_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
assert cut(links).count() == 3
assert connected_components(links).select("component").distinct().count() == 2
assert shared_dir(spark) == shared_dir(spark) == spark.sparkContext.getCheckpointDir()
assert cut(links).count() == 3
print("whole")
"""


def test_without_a_checkpoint_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_CONF")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.split()[-1:] == ["whole"], done.stderr[-2000:]
