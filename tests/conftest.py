import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def canonical(rows, names):
    def plain(v):
        if isinstance(v, float):
            return None if v != v else f"{v:.6g}"
        return f"{float(v):.6g}" if isinstance(v, int) and not isinstance(v, bool) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(plain(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="session")
def agrees(spark, duck):
    """Whether a query and its SQL give the same rows."""
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()

    def check(name):
        df = queries[name](spark, str(DATA))
        own = canonical([tuple(r) for r in df.collect()], df.columns)
        cur = duck.execute(sql[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert own == canonical(cur.fetchall(), names)

    return check
