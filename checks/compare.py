"""Run registered queries next to their oracles: ``python -m checks.compare [sf] [name part ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.all import ORACLES, QUERIES
from codesieve.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def normal(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "item") and not hasattr(v, "__len__"):
            v = v.item()
        if isinstance(v, float):
            return round(v, 6) if v != int(v) else int(v)
        return v if isinstance(v, (int, bool)) else str(v)

    cols = sorted(frame.columns)
    rows = [tuple(cell(v) for v in row) for row in frame[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def oracle(sf: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    return pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)


def run(spark, sf: str, names: list[str]) -> list[str]:
    bad = []
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            ours = pd.DataFrame(rows, columns=df.columns, dtype=object)
            took = time.time() - began
            if name not in ORACLES:
                print(f"rows {name}: {len(ours)} ({took:.1f}s)", flush=True)
                continue
            theirs = oracle(sf, ORACLES[name])
            if sorted(ours.columns) != sorted(theirs.columns):
                raise ValueError(f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}")
            a, b = normal(ours), normal(theirs)
            if a != b:
                only_a = [x for x in a if x not in set(b)][:2]
                only_b = [x for x in b if x not in set(a)][:2]
                raise ValueError(f"{len(a)} / {len(b)} rows; ours {only_a}; oracle {only_b}")
            print(f"ok {name}: {len(a)} ({took:.1f}s){' EMPTY' if not a else ''}", flush=True)
        except Exception as exc:  # report and go on
            bad.append(name)
            print(f"BAD {name}: {str(exc)[:1500]}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} fine; bad: {bad}")
    return bad


if __name__ == "__main__":
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    parts = sys.argv[2:]
    chosen = [n for n in QUERIES if not parts or any(p in n for p in parts)]
    sys.exit(bool(run(local_session(8), sf, chosen)))
