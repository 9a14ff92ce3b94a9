"""Executors need no copy of the package: a driver in another folder, whose workers cannot import it."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()

def importable(it):
    import importlib.util
    for b in it:
        yield b.assign(there=importlib.util.find_spec("fleetctx") is not None)

assert not spark.range(2).mapInPandas(importable, "id long, there boolean").where("there").count()
rows = [(k, "some words of text, " * 12 + f"number {{k}} at 10.0.0.{{k}}", "en" if k % 2 else "de", "s", 1) for k in range(24)]
spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet("documents.parquet")
spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet("benchmark.parquet")
found = __spark_entry__.queries()
for name in sorted(x for x in found if x.startswith("op") or x == "pipeline"):
    found[name](spark, ".").count()
    print("ran", name)
"""


def test_queries_run_where_workers_cannot_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert said.returncode == 0, said.stderr[-2000:]
    assert said.stdout.count("ran ") == 11
