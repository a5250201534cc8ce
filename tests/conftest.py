import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Whether two pandas frames hold the same rows, columns by name, numbers to nine places."""

    def cell(v):
        if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
            return ""
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return repr(round(float(v), 9) + 0.0)
        return str(v)

    def rows(df):
        columns = sorted(df.columns)
        return columns, sorted(tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False))

    def compare(a, b):
        (ca, ra), (cb, rb) = rows(a), rows(b)
        assert ca == cb
        norm = lambda rs: [tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rs]
        assert norm(ra) == norm(rb)

    return compare
