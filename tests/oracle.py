"""Compare a registered query with its oracle SQL on the same parquet tables."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {k: plain(y) for k, y in x.items()}
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return [plain(y) for y in x]
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def compare(spark, con, make, sql, sf_dir):
    frame = make(spark, sf_dir)
    got_cols = frame.columns
    got = table_rows(got_cols, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = table_rows(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    if len(got) != len(want):
        extra = [x for x in got if x not in set(want)][:2]
        lack = [x for x in want if x not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}\n  spark {extra}\n  oracle {lack}"
    if got != want:
        a, b = set(got), set(want)
        return f"values differ ({len(a - b)} rows)\n  spark  {sorted(a - b)[:2]}\n  oracle {sorted(b - a)[:2]}"
    return "" if got else "EMPTY"


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from plainledger.session import local_session

    sf_dir = f"/root/testdata/{argv[0]}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, make in entry.queries().items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        started = time.time()
        try:
            if name in sqls:
                fault = compare(spark, con, make, sqls[name], sf_dir)
            else:
                n = make(spark, sf_dir).count()
                fault = f"no oracle, {n} rows" if n else "no oracle, EMPTY"
        except Exception as err:  # report and go on
            fault = f"{type(err).__name__}: {str(err)[:900]}"
        bad += bool(fault)
        print(f"{'ok ' if not fault else 'BAD'} {time.time() - started:6.2f}s {name} {fault}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
