"""Compare a Spark query with its SQL on DuckDB. Usage: python -m tests.oracle [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, repr(v)) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got.sort(key=_key)
    want.sort(key=_key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = [(c, type(a).__name__, type(b).__name__) for g, w in zip(got[:50], want[:50]) for c, a, b in zip(cols, g, w)
             if a is not None and b is not None and type(a) is not type(b)]
    neg = [g for g in got if any(isinstance(v, float) and v == 0 and math.copysign(1, v) < 0 for v in g)]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"
    if types:
        return f"types differ {types[0]}"
    if neg:
        return "negative zero"
    return None


def main(argv):
    from cellweave.session import get_session
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(qs)
    failed = []
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf_dir)
            if n in sqls:
                msg = compare(df, con, sqls[n])
                rows = ""
            else:
                msg, rows = None, f" rows-only {df.count()}"
        except Exception as ex:  # noqa: BLE001 - report every query
            msg, rows = f"{type(ex).__name__}: {str(ex)[:600]}", ""
        print(f"{'ok  ' if msg is None else 'FAIL'} {n} {time.time() - t:.1f}s{rows} {msg or ''}", flush=True)
        if msg:
            failed.append(n)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
