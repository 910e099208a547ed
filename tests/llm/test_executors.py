"""Corpus queries on Python workers that have no copy of the package: they start in an empty folder, the driver alone has the path."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DRIVER = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def missing(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("quantloom") is None
        yield b

assert spark.range(4).mapInArrow(missing, "id long").count() == 4  # the workers are as the test wants them
sys.path.insert(0, sys.argv[1])
import __spark_entry__
every = __spark_entry__.queries()
for name in [n for n in every if n.startswith("op") or n == "pipeline"]:
    every[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
"""


@pytest.fixture(scope="module")
def ran(tmp_path_factory):
    empty, shared = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("shared")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", DRIVER, REPO, str(shared)], cwd=empty, env=env, capture_output=True, text=True, timeout=900)
    return done.stdout, done.stderr


@pytest.mark.parametrize("name", [*(f"op{i}_" for i in range(1, 14)), "pipeline"])
def test_query_needs_no_package_on_executors(ran, name):
    assert f"ran {name}" in ran[0], ran[1][-3000:]
