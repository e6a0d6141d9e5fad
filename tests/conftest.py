import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def oracle():
    """Runs a query at the smallest scale against its SQL; rows are compared as sorted texts."""
    import duckdb
    import pandas as pd

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")

    def rows(df):
        def text(x):
            if x is None or x is pd.NA or x is pd.NaT or x != x:
                return "null"
            return f"{float(x):.5f}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

        df = df[sorted(df.columns)].astype(object)
        return sorted(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False))

    def check(spark, query, sql):
        ours, theirs = rows(query(spark, sf).toPandas()), rows(con.execute(sql).df())
        assert ours[0] == theirs[0]
        assert ours[1] == theirs[1]
        return len(ours[1])

    return check
