"""Holds a query's rows against its SQL, as the driver does: names, count, and values without order."""

import glob
import os

import duckdb


def differences(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    order = [next(i for i, d in enumerate(want.description) if d[0] == n) for n in names]
    want = [tuple(r[i] for i in order) for r in want.fetchall()]
    df = query(spark, sf_dir)
    if sorted(df.columns) != names:
        return [f"{name}: columns {sorted(df.columns)}, not {names}"]
    got = [tuple(r) for r in df.select(*(f"`{n}`" for n in names)).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    bad = [(a, b) for a, b in zip(sorted(got, key=key), sorted(want, key=key)) if a != b]
    return ([f"{name}: {len(got)} rows, not {len(want)}"] if len(got) != len(want) else []) + [f"{name}: {a} not {b}" for a, b in bad[:3]]
