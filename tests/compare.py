"""Runs queries and their SQL side by side; also a command: python tests/compare.py SF [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        v = float(v)
        if math.isnan(v):
            return "NaN"
        if v == 0:
            return 0
        return int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.6g}")
    if hasattr(v, "isoformat"):
        v = v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return [f"columns {sorted(df.columns)} against {sorted(cols)}"], sum(got.values())
    out = []
    if got != want:
        out.append(f"rows {sum(got.values())} against {sum(want.values())}; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}")
    return out, sum(got.values())


def main(sf, names):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e
    from rideloom.session import local_session

    spark = local_session(cores=8)
    d = f"/root/testdata/{sf}"
    con, q, s = duck(d), e.queries(), e.oracle_sql()
    bad = []
    for name in [n for n in q if not names or any(n == x or x.endswith("*") and n.startswith(x[:-1]) for x in names)]:
        t = time.time()
        try:
            df = q[name](spark, d)
            if name in s:
                diff, n = differences(df, con, s[name])
            else:
                diff, n = [], df.count()
            note = "ok" if name in s else "rows only"
        except Exception as ex:  # noqa: BLE001
            diff, n, note = [f"{type(ex).__name__}: {str(ex)[:700]}"], 0, ""
        print(f"{name}: {'DIFF ' + diff[0][:1500] if diff else note} ({n} rows, {time.time() - t:.1f} s)", flush=True)
        bad += [name] if diff else []
    print("bad:", *bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
