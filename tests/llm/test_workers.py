"""Workers that cannot import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = f"""
import os, sys
sys.path.insert(0, {ROOT!r})
os.environ.pop("PYTHONPATH", None)
from tessella import build_session
spark = build_session("workers", "local[2]", **{{"spark.sql.shuffle.partitions": 2, "spark.ui.enabled": "false"}})
can = spark.range(1).mapInPandas(lambda frames: (f.assign(id=int(__import__("importlib").util.find_spec("tessella") is not None)) for f in frames), "id long").first()[0]
assert can == 0, "the worker sees the package"
import __spark_entry__ as entry
queries, folder = entry.queries(), "/root/testdata/sf0.001"
for name in ("op8_quality_classifier", "op12_prefix_trie", "op13_periodic_runs"):
    assert queries[name](spark, folder).count() > 0, name
print("DONE")
"""


def test_queries_without_the_package_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "DONE" in done.stdout, done.stderr[-3000:]
