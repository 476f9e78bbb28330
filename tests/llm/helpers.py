"""Rows that every operator has to survive, and small brute-force pieces."""

from __future__ import annotations

import os

import duckdb

SF = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
#: Columns named like those that operators make for themselves.
CLASHES = "fp string, h string, key string, line string, n string, ids string, score double, recipe string, component_id string, _gone string, mask string, place string, predicted string"


def docs(spark, rows, clash: bool = True):
    """A documents table of ``(doc_id, text)`` rows, with columns whose names clash."""
    extra = CLASHES if clash else "lang string"
    n = extra.count(",") + 1
    return spark.createDataFrame([(i, t, *[None] * n) for i, t in rows], f"doc_id bigint, text string, {extra}").coalesce(3)


LONG = "Über lange Wörter, and more of them. " * 60_000

HARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "\x0b\x0c\r"), (5, "a"), (5, "a"), (6, "日本語のテキスト — ünïcödé"), (7, LONG), (8, LONG), (9, "x" * 300_000), (10, "\x00\x01 nul"),
]


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])


def matches_sql(df, sql: str, folder: str) -> None:
    """The frame's rows are those of the SQL over the tables in ``folder``."""
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    other = con.execute(sql).df()
    assert sorted(df.columns) == sorted(other.columns)
    columns = sorted(df.columns)
    rows = lambda frame: sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))
    assert rows(df.toPandas()) == rows(other)


def sql_rows(sql: str, folder: str, columns) -> list[tuple]:
    """Rows of the SQL over the tables in ``folder``, in the order of their text."""
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)


class Union:
    """Union-find with the smallest member as root."""

    def __init__(self, items) -> None:
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
