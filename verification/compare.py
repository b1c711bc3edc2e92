"""Run queries next to their SQL: ``python -m verification.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(
        tuple((type(_plain(r[i])).__name__, _plain(r[i])) for i in order) for r in rows
    )


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both results hold the same rows, else what differs first."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    expected = _rows(names, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got == expected:
        return None
    extra, lacking = list((got - expected).items()), list((expected - got).items())
    return (
        f"{sum(got.values())} rows against {sum(expected.values())}; "
        f"only here {[[v for _, v in r] for r, _ in extra[:2]]}; only there {[[v for _, v in r] for r, _ in lacking[:2]]}"
    )


def main(argv: list[str]) -> int:
    from traffic_risk.session import local_session
    from verification.queries import CHECKS, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.perf_counter()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in CHECKS:
                diff = differences(df, con, CHECKS[name])
                state = "ok" if diff is None else f"DIFFERS {diff}"
            else:
                state = f"rows {df.count()}"
        except Exception as e:  # report and go on with the next query
            state = f"FAILS {type(e).__name__} {str(e)[:600]}"
        bad += state.startswith(("DIFFERS", "FAILS"))
        print(f"{name:32s} {time.perf_counter() - start:6.2f}s {state}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
