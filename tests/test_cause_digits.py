"""Probabilities of causes among tens of millions of lots, digit by digit as in the SQL, whose rounding shows in scores."""

import duckdb
from pyspark.sql import functions as F

from lotgraph.functions import stats
from lotgraph.plans import engines

NG, LOTS = 10_938_300, 27_411_660  # the bad lots and all lots of 60 times sf0.1


def test_as_the_sql_rounds(spark):
    cells = [(a, b, NG - a, LOTS - NG - b) for a in range(9) for b in range(9) if a + b] + [(a, 567 - a, NG - a, LOTS - NG - 567 + a) for a in range(190, 266, 3)]
    cells += [(3_000_000, 4_520_000, NG - 3_000_000, LOTS - NG - 4_520_000)]
    con = duckdb.connect()
    con.execute("create table t (kind varchar, candidate varchar, a bigint, b bigint, c bigint, d bigint)")
    con.executemany("insert into t values ('MACHINE', ?, ?, ?, ?, ?)", [(str(k), *row) for k, row in enumerate(cells)])
    want = dict(con.execute(f"WITH one AS (SELECT 1){engines._FISHER} SELECT candidate::INT, p FROM fi").fetchall())
    rows = spark.createDataFrame([(k, *row) for k, row in enumerate(cells)], "k int, a long, b long, c long, d long")
    got = {r.k: r.p for r in rows.select("k", stats.fisher_exact(*[F.col(c) for c in "abcd"]).alias("p")).collect()}
    assert sorted(got) == sorted(want)
    assert [cells[k] for k in got if abs(got[k] - want[k]) > 2e-8] == []  # one term whose logarithm is a digit off
    assert [cells[k] for k in got if round(got[k], 6) != round(want[k], 6)] == []


def test_logarithms_of_factorials(spark):
    n = [*range(40), 99, 2**20 - 2, 2**20 - 1, 2**20, 27_411_660, 36_000_000, 2**31]
    want = duckdb.sql(f"SELECT lgamma(x + 1) FROM (SELECT unnest({n}) AS x)").fetchall()
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(n)], "k int, n long").orderBy("k")
    assert [(r.v,) for r in rows.select(stats.log_gamma_sum(F.col("n")).alias("v")).collect()] == want
