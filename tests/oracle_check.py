"""Runs registered queries next to their SQL: python -m tests.oracle_check SF_DIR [names...]"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime().replace(tzinfo=None)
    if hasattr(x, "item"):
        return x.item()
    return x


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty text when both sides agree."""
    from mapaudit.plans.oracle import ORACLE
    from mapaudit.plans.registry import QUERIES

    df = QUERIES[name](spark, sf_dir)
    got_cols, got = rows(df.columns, df.collect())
    cur = con.execute(ORACLE[name])
    want_cols, want = rows([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    from mapaudit.plans.oracle import ORACLE
    from mapaudit.plans.registry import QUERIES
    from tests.conftest import make_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf)
    for n in names or QUERIES:
        t = time.time()
        try:
            if n in ORACLE:
                verdict = compare(spark, con, n, sf) or "ok"
            else:
                verdict = f"no oracle, {QUERIES[n](spark, sf).count()} rows"
        except Exception as e:  # report and go on with the next query
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{n}: {verdict} [{time.time() - t:.1f}s]", flush=True)
