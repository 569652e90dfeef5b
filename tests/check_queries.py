"""Compare named queries with their DuckDB text: ``python tests/check_queries.py [sf_dir] [name ...]``."""
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


def compare(spark, con, name, sf_dir):
    """Problem text, or '' when columns, types in kind, and rows agree."""
    df = E.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    sql = E.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    simple = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for f in df.schema.fields:
        if simple.get(f.dataType.simpleString()) != kinds[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} != {kinds[f.name]}"
    want = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    if got == want:
        return "" if got else "no rows"
    a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return f"{len(got)} rows, {len(want)} wanted; columns {cols}\n   only spark: {a}\n   only sql:   {b}"


def main():
    from roamlog.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in args or E.queries():
        t = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problem)
        print(f"{'ok ' if not problem else 'BAD'} {name} {time.time() - t:.1f}s {problem}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
