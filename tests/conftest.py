"""One local session for all tests, the driver's small tables, and a comparison with SQL."""

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from civitas.session import session

    shared, warehouse = tmp_path_factory.mktemp("shared"), tmp_path_factory.mktemp("warehouse")
    conf = {"spark.master": "local[4]", "spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(warehouse), "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}
    made = session("tests", **conf)
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def same_as_sql(sf):
    """A check that a DataFrame has the rows of a SQL query over the same tables, whatever their order."""
    import duckdb

    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.6f}"
        return f"{x:.6f}" if type(x).__name__ == "Decimal" else str(x) if x is not None else "null"

    def check(df, sql):
        names = sorted(df.columns)
        found = base.execute(sql)
        theirs = [c[0] for c in found.description]
        assert sorted(theirs) == names
        at = [theirs.index(c) for c in names]
        expected = sorted([value(r[i]) for i in at] for r in found.fetchall())
        rows = sorted([value(r[c]) for c in names] for r in df.select(names).collect())
        assert len(rows) == len(expected)
        for got, want in zip(rows, expected):
            assert got == want

    return check
