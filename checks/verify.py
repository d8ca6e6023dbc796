"""Run registered queries beside their SQL in DuckDB and compare rows, types and values.

    python -m checks.verify [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
from collections import Counter

from recspark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(table) -> tuple[list[str], list[str], Counter]:
    names = sorted(table.column_names)
    kinds = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    return names, kinds, Counter(tuple(_plain(v) for v in row) for row in zip(*columns))


def compare(spark_table, sql_table) -> str:
    """'' when equal, else what differs."""
    names, kinds, rows = rows_of(spark_table)
    other_names, other_kinds, other_rows = rows_of(sql_table)
    if names != other_names:
        return f"columns {names} <> {other_names}"
    notes = [f"{n}: {a} <> {b}" for n, a, b in zip(names, kinds, other_kinds) if a != b]
    if rows != other_rows:
        left = [[v[:60] for v in row] for row in list(rows - other_rows)[:2]]
        right = [[v[:60] for v in row] for row in list(other_rows - rows)[:2]]
        notes.append(
            f"{sum(rows.values())} rows <> {sum(other_rows.values())} rows, {sum((rows - other_rows).values())} differ"
            f"\n   spark {left}\n   sql   {right}"
        )
    return "; ".join(notes)


def main() -> None:
    from checks.oracle import ORACLES
    from checks.queries import REGISTRY

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    bad = 0
    for name in args.names or list(REGISTRY):
        start = time.time()
        try:
            result = REGISTRY[name](spark, args.sf).toArrow()
            took = time.time() - start
            if name not in ORACLES:
                verdict = "rows only"
            else:
                begin = time.time()
                expected = con.sql(ORACLES[name]).to_arrow_table()
                verdict = compare(result, expected) or f"ok (sql {time.time() - begin:.1f}s)"
                bad += not verdict.startswith("ok")
            print(f"{name:26} {result.num_rows:8} rows {took:6.1f}s  {verdict[:1500]}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name:26} failed after {time.time() - start:.1f}s: {str(error)[:1500]}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
