"""Run queries against their SQL: ``python tools/check.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(v) if not isinstance(v, float) else f"{v:.6f}") for v in row)


def compare(got_cols, got, want_cols, want) -> str:
    if sorted(got_cols) != sorted(want_cols):
        return f"COLUMNS spark-only={set(got_cols) - set(want_cols)} sql-only={set(want_cols) - set(got_cols)}"
    order = sorted(got_cols)
    gi, wi = [got_cols.index(x) for x in order], [want_cols.index(x) for x in order]
    g = sorted((tuple(r[i] for i in gi) for r in got), key=key)
    w = sorted((tuple(r[i] for i in wi) for r in want), key=key)
    if len(g) != len(w):
        return f"ROWS {len(g)} != {len(w)}"
    bad, soft = {}, 0
    for a, b in zip(g, w):
        for name, x, y in zip(order, a, b):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1.5e-6):
                soft += 1
                continue
            if name not in bad:
                bad[name] = [0, x, y, a, b]
            bad[name][0] += 1
    if bad:
        return "VALUES " + "; ".join(f"{k}: n={v[0]} {v[1]!r} vs {v[2]!r} @ {v[3]}|{v[4]}"[:330] for k, v in list(bad.items())[:3])
    return f"ok rows={len(g)}" + (f" LASTDIGIT={soft}" if soft else "")


def main() -> None:
    from panelloom.plans.catalog import ORACLES, QUERIES
    from panelloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    path = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(path)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, path)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t0
            if name in ORACLES:
                t1 = time.time()
                rel = con.execute(ORACLES[name])
                status = compare(df.columns, rows, [d[0] for d in rel.description], rel.fetchall())
                status += f" sql={time.time() - t1:.1f}s"
            else:
                status = f"norsql rows={len(rows)}"
        except Exception as e:
            took, status = time.time() - t0, f"ERROR {type(e).__name__} {str(e)[:700]}"
        if not status.startswith(("ok", "norsql")) or "LASTDIGIT" in status:
            bad += 1
        print(f"{name:42s} {took:6.1f}s {status}", flush=True)
    print("not clean:", bad)


if __name__ == "__main__":
    main()
