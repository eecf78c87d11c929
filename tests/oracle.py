"""Runs a query and its SQL on the same tables and compares the rows."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, sf_dir):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.collect(), df.columns) == _rows(found.fetchall(), columns)
