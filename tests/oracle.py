"""Side-by-side run of the registered queries and their SQL."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _key(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float)) else "n"), v if v is not None else 0) for v in row)


def compare(spark_df, con, sql: str, verbose: bool = False) -> str | None:
    """None if equal, else what differs."""
    started = time.time()
    got = [tuple(r) for r in spark_df.collect()]
    between = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    if verbose:
        print(f"    spark {between - started:.1f}s sql {time.time() - between:.1f}s", flush=True)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    wrong_types = []
    for f in spark_df.schema.fields:
        mine, theirs = f.dataType.simpleString(), kinds[f.name].upper()
        if TYPES.get(mine) != theirs:
            wrong_types.append(f"{f.name}: {mine} vs {theirs}")
    if wrong_types:
        return "types " + ", ".join(wrong_types)
    if len(got) != len(expected):
        return f"rows {len(got)} vs {len(expected)}"
    pick = lambda cols, rows: sorted((tuple(_plain(r[cols.index(c)]) for c in sorted(cols)) for r in rows), key=_key)
    a, b = pick(spark_df.columns, got), pick(names, expected)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None


def main(folder: str, only: list[str]) -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tessella import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                result = compare(df, con, sqls[name], bool(only)) or "ok"
            else:
                result = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            result = f"ERROR {type(e).__name__} {str(e)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
