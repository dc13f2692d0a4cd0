import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    """Rows in one order, columns by name, doubles to six digits."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{round(v, 6) + 0.0:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="session")
def same():
    def check(df, relation):
        names = [c[0] for c in relation.description]
        assert sorted(df.columns) == sorted(names)
        assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(relation.fetchall(), names)

    return check
