"""Run one registered query and its SQL and compare them value by value.

`python tests/compare.py [sf_dir] [name ...]` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import pyarrow as pa  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(t: pa.Table) -> tuple[list[str], list[tuple]]:
    names = sorted(t.column_names)
    lists = [t.column(n).to_pylist() for n in names]
    return names, sorted(zip(*lists), key=repr) if lists else []


def kinds(t: pa.Table) -> dict[str, str]:
    plain = {"large_string": "string", "large_binary": "binary"}
    return {f.name: plain.get(str(f.type), str(f.type)) for f in t.schema}


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    """What differs, or None."""
    a, b = kinds(spark_table), kinds(sql_table)
    if a != b:
        only = {k: (a.get(k), b.get(k)) for k in sorted(set(a) | set(b)) if a.get(k) != b.get(k)}
        return f"schema {only}"
    names, left = rows_of(spark_table)
    _, right = rows_of(sql_table)
    if len(left) != len(right):
        return f"{len(left)} rows, SQL gives {len(right)}"
    wrong = [(x, y) for x, y in zip(left, right) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first {dict(zip(names, wrong[0][0]))} / {dict(zip(names, wrong[0][1]))}"
    return None


def main() -> None:
    from tunekit.catalog.all import ORACLES, QUERIES
    from tunekit.sources.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = local_session("8")
    con = connect(sf_dir)
    bad = 0
    for n in names:
        start = time.time()
        try:
            got = QUERIES[n](spark, sf_dir).toArrow()
            took = time.time() - start
            if n in ORACLES:
                why = difference(got, con.execute(ORACLES[n]).to_arrow_table())
                note = f"{got.num_rows} rows" if why is None else why
            else:
                why, note = None, f"{got.num_rows} rows, no SQL"
            if got.num_rows == 0:
                note += " EMPTY"
        except Exception as e:  # noqa: BLE001
            why, took = str(e).split("JVM stacktrace")[0][:1500], time.time() - start
            note = why
        bad += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {n} {took:.1f}s {note}", flush=True)
    print(f"{bad} of {len(names)} failed")


if __name__ == "__main__":
    main()
