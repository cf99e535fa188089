"""Every user table of SQLite files as long-form rows, read in parallel.

A Python data source (``spark.read.format("sqlite_tables")``): one input
partition per (file, table, rowid range), each opened read-only with the
standard library. Tables named ``sqlite_%`` are skipped; a table that cannot
be read yields no rows (and the others still load).
"""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, tbl string, rowid long, columns array<string>, cells array<string>"


class _Part(InputPartition):
    def __init__(self, path, table, lo, hi):
        self.path, self.table, self.lo, self.hi = path, table, lo, hi


def _connect(path):
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Reader(DataSourceReader):
    def __init__(self, paths, rows_per_part):
        self.paths, self.rows_per_part = paths, rows_per_part

    def partitions(self):
        parts = []
        for path in self.paths:
            con = _connect(path)
            try:
                names = [r[0] for r in con.execute(
                    "SELECT name FROM sqlite_master WHERE type='table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
                for t in names:
                    try:
                        lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{t}"').fetchone()
                    except sqlite3.Error:
                        continue
                    if lo is None:
                        continue
                    for start in range(lo, hi + 1, self.rows_per_part):
                        parts.append(_Part(path, t, start, min(hi, start + self.rows_per_part - 1)))
            finally:
                con.close()
        return parts or [_Part(None, None, 0, -1)]

    def read(self, partition):
        if partition.path is None:
            return
        con = _connect(partition.path)
        try:
            cur = con.execute(f'SELECT rowid, * FROM "{partition.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid',
                              (partition.lo, partition.hi))
            cols = [d[0] for d in cur.description][1:]
            for row in cur:
                yield (partition.path, partition.table, int(row[0]), cols,
                       [None if v is None else str(v) for v in row[1:]])
        except sqlite3.Error:
            return
        finally:
            con.close()


class SqliteTables(DataSource):
    @classmethod
    def name(cls):
        return "sqlite_tables"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        paths = [p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p]
        return _Reader(paths, int(self.options.get("rowsPerPartition", 100_000)))


def scan_sqlite_tables(spark, paths: list[str], rows_per_partition: int = 100_000):
    spark.dataSource.register(SqliteTables)
    return (spark.read.format("sqlite_tables").option("paths", ",".join(paths))
            .option("rowsPerPartition", rows_per_partition).load())
