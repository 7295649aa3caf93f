"""Side-by-side check of the registered queries against their SQL in DuckDB."""
from __future__ import annotations

import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if value != value else float(f"{value:.6g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_canon(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_canon(r[i]) for i in order) for r in rows), key=repr)


def check(spark, sf_dir, name, query, sql, con=None):
    """Return (ok, message)."""
    con = con or duck(sf_dir)
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    t2 = time.time()
    note = f"{name}: {len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"{note} COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return False, f"{note} ROWS {len(got)} vs {len(want)}; extra {[g for g in got if g not in set(map(tuple, want))][:3]} missing {[w for w in want if w not in set(got)][:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{note} VALUES {len(bad)} differ, first {bad[0]}"
    types = [(n, str(t)) for n, t in zip(names, [d[1] for d in cur.description])]
    return True, note + ("" if got else " EMPTY")
