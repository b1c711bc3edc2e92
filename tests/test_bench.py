"""The benchmark runs to its end and prints one JSON line."""

import json
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2"}
    run = subprocess.run([sys.executable, str(ROOT / "bench.py"), "daily_summary"], env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    told = json.loads(run.stdout.strip())
    assert told["unit"] == "sec" and told["value"] > 0
    assert set(told["queries"]) == set(told["duckdb"]) == set(told["ratio"]) == {"daily_summary"}
