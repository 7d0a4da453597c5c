import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dayloom.session import session

    s = session("local[4]", 4, **{"spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows_of(pdf):
    """Rows without order, columns by name, as text (doubles to six digits)."""
    import pandas as pd

    def show(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return "NULL"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(show(v) for v in row) for row in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(df, frame):
        assert rows_of(df.toPandas()) == rows_of(frame)

    return check
