import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from arcavec.session import session

    at = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(at / "warehouse"), spark__checkpoint__dir=str(at / "shared"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same_rows():
    """Compares a query's rows with those of its SQL in DuckDB."""
    import duckdb

    con = duckdb.connect()
    folder = DATA / "sf0.001"
    for p in sorted(folder.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def value(v):
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)

    def check(df, sql):
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        wanted = sorted(tuple(value(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
        found = sorted(tuple(value(r[c]) for c in sorted(names)) for r in df.collect())
        assert found == wanted

    return check
