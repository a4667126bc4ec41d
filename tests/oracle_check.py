"""Compare registered queries with their DuckDB oracles.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def expected(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return names, result.fetchall()


def normalized(names, rows):
    """Rows as texts, columns by name, rows sorted."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def difference(spark, sf_dir: str, query, sql: str) -> str | None:
    df = query(spark, sf_dir)
    names, rows = expected(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    got = normalized(df.columns, df.collect())
    want = normalized(names, rows)
    if got == want:
        return None
    extra = sorted(set(got) - set(want))[:2]
    lost = sorted(set(want) - set(got))[:2]
    return f"{len(got)} rows instead of {len(want)}\n  only Spark: {extra}\n  only DuckDB: {lost}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from repoaudit.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sqls = oracle_sql()
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        begin = time.time()
        try:
            wrong = difference(spark, sf_dir, query, sqls[name])
        except Exception as error:  # report and go on with the next query
            wrong = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok ' if wrong is None else 'BAD'} {name} {time.time() - begin:.1f}s", flush=True)
        if wrong:
            print(" ", wrong[:1500], flush=True)


if __name__ == "__main__":
    main()
