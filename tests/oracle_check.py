"""Run registered queries next to their SQL in DuckDB: ``python tests/oracle_check.py [sf] [name prefix ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"rows {len(got)} vs {len(want)}; first differences {diff}", len(got)
    return True, "", len(got)


def main(argv):
    import __spark_entry__ as entry
    from meterloom.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.perf_counter()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                ok, why, n = compare(df, con, oracles[name])
            else:
                n = df.count()
                ok, why = n > 0, "no rows" if n == 0 else ""
        except Exception as e:  # report and go on with the next query
            ok, why, n = False, f"{type(e).__name__}: {str(e)[:600]}", -1
        mark = "ok " if ok else "BAD"
        print(f"{mark} {name:44s} {'sql' if name in oracles else 'inv'} rows={n} {time.perf_counter() - start:.1f}s {why}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
