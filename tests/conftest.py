"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["TZ"] = "UTC"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL on the smallest tables and compares all rows."""
    import duckdb

    if not DATA.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")

    def plain(x):
        if isinstance(x, bool):
            return int(x)
        if isinstance(x, float):
            return "nan" if x != x else f"{x:.5g}"
        if isinstance(x, (list, tuple)):
            return [plain(y) for y in x]
        return x.isoformat() if hasattr(x, "isoformat") else x

    def run(query, sql):
        df = query(spark, str(DATA))
        cols = sorted(df.columns)
        got = sorted(str([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted(str([plain(row[i]) for i in at]) for row in r.fetchall())
        assert got == want

    return run
