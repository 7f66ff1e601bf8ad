"""Run registered queries against DuckDB: ``python -m tests.oracle [sf] [name ...]``."""

import sys
import time

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for name in NAMES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, run, sql):
    """(problem or None, rows)"""
    frame = run(spark, folder)
    got = frame.toArrow()
    if sql is None:
        return None, got.num_rows
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {got.column_names} / {want.column_names}", got.num_rows
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} / {want.num_rows}", got.num_rows
    kinds = [(n, str(got.schema.field(n).type), str(want.schema.field(n).type)) for n in sorted(got.column_names)]
    odd = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]
    names = sorted(got.column_names)
    rows = [sorted(zip(*[t.column(n).to_pylist() for n in names]), key=repr) for t in (got, want)]
    if rows[0] != rows[1]:
        diff = [(a, b) for a, b in zip(*rows) if a != b]
        return f"{len(diff)} values of {got.num_rows}, first {diff[:2]} types {odd}", got.num_rows
    return (f"types {odd}" if odd else None), got.num_rows


def main():
    import __spark_entry__ as entry
    from lorelink.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            problem, rows = compare(spark, con, folder, queries[name], sqls.get(name))
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        print(f"{name:28s} {'ok' if problem is None else 'BAD'} rows={rows} {time.time() - start:.1f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
        bad += [name] if problem else []
    print("failed:", bad)


if __name__ == "__main__":
    main()
