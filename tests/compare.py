"""Compare a Spark result with a DuckDB result cell by cell."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(row[i] for i in order) for row in rows]
    return sorted(columns), sorted(cells, key=repr)


def differences(spark_df, connection, statement: str) -> list[str]:
    found_columns, found = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = connection.execute(statement)
    wanted_columns, wanted = _rows([d[0] for d in result.description], result.fetchall())
    problems = []
    if found_columns != wanted_columns:
        return [f"columns {found_columns} != {wanted_columns}"]
    if len(found) != len(wanted):
        problems.append(f"{len(found)} rows != {len(wanted)}")
    for a, b in zip(found, wanted):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            gap = max(
                (abs(x - y) for x, y in zip(a, b) if isinstance(x, float) and isinstance(y, float)), default=math.nan
            )
            problems.append(f"{a} != {b} (float gap {gap})")
            if len(problems) > 4:
                break
    return problems
