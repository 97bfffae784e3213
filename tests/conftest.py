from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from emberlog.session import local_session

    return local_session(cores=4, partitions=4, spark__driver__memory="6g")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF


def canonical(rows) -> list[tuple]:
    """Rows as sortable tuples, floats rounded to nine digits."""

    def one(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


def duck(sf_dir: str, sql: str):
    """(columns, rows) of a DuckDB query over the tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def agree(df, sf_dir: str, sql: str) -> None:
    columns, rows = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = canonical(df.select(*[f"`{c}`" for c in order]).collect())
    theirs = canonical([[r[columns.index(c)] for c in order] for r in rows])
    assert len(ours) == len(theirs)
    assert ours == theirs
