import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spotloom.session import build_session, ship_package

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


class Oracle:
    """Spark's rows of a query against DuckDB's of its SQL, in any order, columns by name."""

    def __init__(self, folder):
        import duckdb

        self.con = duckdb.connect()
        for f in os.listdir(folder):
            self.con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")

    def rows(self, sql):
        r = self.con.execute(sql)
        names = [d[0] for d in r.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return [names[i] for i in order], sorted(tuple(_plain(x[i]) for i in order) for x in r.fetchall())

    def check(self, df, sql):
        names, want = self.rows(sql)
        assert sorted(df.columns) == names
        got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
        assert len(got) == len(want)
        assert got == want


@pytest.fixture(scope="session")
def oracle(sf):
    return Oracle(sf)
