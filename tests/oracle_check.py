"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "DECIMAL(5,4)": "decimal(5,4)",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal | dt.datetime | dt.date):
        return str(v)
    if isinstance(v, list | tuple):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def compare(name: str, got, con, sql: str) -> list[str]:
    """Problems found, none when names, types, counts and values agree."""
    rel = con.sql(sql)
    want_cols = dict(zip(rel.columns, map(str, rel.types), strict=True))
    have_cols = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    if set(want_cols) != set(have_cols):
        return [f"columns {sorted(have_cols)} != {sorted(want_cols)}"]
    problems = [
        f"type of {c}: {have_cols[c]} != {t}" for c, t in want_cols.items() if TYPES.get(t, t) != have_cols[c]
    ]
    cols = sorted(have_cols)
    have = sorted((tuple(_norm(r[c]) for c in cols) for r in got.select(*cols).collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(have) != len(want):
        problems.append(f"rows {len(have)} != {len(want)}")
    if have != want:
        only_have, only_want = set(have) - set(want), set(want) - set(have)
        problems.append(f"{len(only_have)} rows only here, {len(only_want)} only in SQL {cols}")
        for side, rows in (("here", only_have), ("sql", only_want)):
            problems += [f"  {side}: {str(r)[:400]}" for r in sorted(rows, key=repr)[:3]]
    if not have:
        problems.append("no rows")
    return problems


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    import __spark_entry__ as entry
    from tidewell.session import get_spark

    spark = get_spark(
        master="local[8]",
        conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
              "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    QUERIES, ORACLES = entry.queries(), entry.oracle_sql()  # noqa: N806
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            if name in ORACLES:
                problems = compare(name, df, con, ORACLES[name])
            else:
                n = df.count()
                problems = [] if n else ["no rows"]
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        bad += bool(problems)
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{'FAIL' if problems else 'ok  '} {name}{kind} {time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print(f"{bad} of {len(args.names or QUERIES)} failed")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
