"""Export of small tables to a SQLite file, for checks by another engine."""

from __future__ import annotations

import sqlite3
from itertools import islice

from pyspark.sql import types as T

from .catalog import Catalog

BATCH = 1024


def _affinity(dtype: T.DataType) -> str:
    return "INTEGER" if isinstance(dtype, T.IntegralType) else "REAL" if isinstance(dtype, T.FractionalType) else "TEXT"


def _plain(value):
    return value if value is None or isinstance(value, (int, float, str)) else str(value)


def write_sqlite(catalog: Catalog, path: str, names: list[str] | None = None) -> dict[str, int]:
    """Write tables of a catalog, a batch of rows at a time; rows by table.

    The file is on the driver: this is for test databases, not for large tables.
    """
    written = {}
    with sqlite3.connect(path) as con:
        for t in catalog.tables:
            if names is not None and t.name not in names:
                continue
            columns = ", ".join(f'"{c.name}" {_affinity(c.dtype)}' for c in t.columns)
            con.execute(f'DROP TABLE IF EXISTS "{t.name}"')
            con.execute(f'CREATE TABLE "{t.name}" ({columns})')
            rows = catalog.table(t.name).toLocalIterator()
            insert, n = f'INSERT INTO "{t.name}" VALUES ({", ".join("?" * len(t.columns))})', 0
            while batch := [tuple(map(_plain, r)) for r in islice(rows, BATCH)]:
                con.executemany(insert, batch)
                n += len(batch)
            written[t.name] = n
    return written
