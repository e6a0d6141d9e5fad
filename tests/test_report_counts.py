"""The report's late orders are counted, not listed: many cases and many orders of one product and day."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from lotgraph.operators import forward
from lotgraph.plans import engines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Tables whose orders are all due, and whose incidents all begin, in the same few days, so that stocks run out."""
    root = str(tmp_path_factory.mktemp("crowded"))
    due = "TIMESTAMP '1996-01-09' + to_days((o_orderkey % 5)::INT)"
    duckdb.sql(f"COPY (SELECT * REPLACE ({due} AS o_orderdate) FROM '{SF}/orders.parquet') TO '{root}/orders.parquet'")
    shipped = f"{due.replace('o_order', 'l_order')} + to_days((l_linenumber % 2)::INT)"
    duckdb.sql(f"COPY (SELECT * REPLACE ({shipped} AS l_shipdate) FROM '{SF}/lineitem.parquet') TO '{root}/lineitem.parquet'")
    duckdb.sql(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-09 01:00:00' + to_minutes((event_id * 7 % 4000)::INT) AS ts, user_id % 8 AS user_id) FROM '{SF}/events.parquet') TO '{root}/events.parquet'")
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/part.parquet') TO '{root}/part.parquet'")
    return root


def test_report_of_crowded_days_equals_sql(spark, crowded):
    con = duckdb.connect()
    for t in "orders lineitem events part".split():
        con.execute(f"create view {t} as select * from '{crowded}/{t}.parquet'")
    want = {m: (v, p) for m, v, _, p in con.execute(engines.SQL["run_report"]).fetchall()}
    report = engines.run_report(spark, crowded)
    assert {r.metric: (r.value, r.passed) for r in report.collect()} == want
    assert 0 < want["forward_f1"][0] and 0 < want["late_hit_rate"][0]
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(jt_id" not in plan and "collect_set(cast(jt_id" not in plan  # a list of orders for each case


def test_counts_are_those_of_the_list(spark, crowded):
    c = engines._cascade(spark, crowded)
    today = c.queue.where("due_idx = 0").select("product", "day0", "jt_id", F.lit(1).alias("today"))
    listed = forward.late_list(c).join(c.cases.select("case_id", "product", "day0"), "case_id").join(today, ["product", "day0", "jt_id"], "left")
    listed = listed.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_late"), F.count("today").alias("n_today"), F.round(F.sum("short"), 3).alias("shortfall"), F.round(F.max("p_late"), 9).alias("p_late"))
    counted = forward.late_counts(c).where("n_late > 0").select("case_id", "n_late", "n_today", F.round("shortfall", 3).alias("shortfall"), F.round("p_late", 9).alias("p_late"))
    rows = sorted(map(tuple, listed.collect()))
    assert rows == sorted(map(tuple, counted.collect()))
    assert any(r[2] for r in rows) and any(r[3] for r in rows)


def test_orders_that_only_miss_their_truck(spark):
    t = dt.datetime(2024, 1, 9, 22)
    cases = spark.createDataFrame([("a", 1, t, 8), ("b", 1, t, 1)], "case_id string, station_id long, start_ts timestamp_ntz, hours int")
    lots = spark.createDataFrame([("L", "P", 10**6, t)], "lot_id string, product string, qty long, created timestamp_ntz")
    events = spark.createDataFrame([(1, "L", t)], "station_id long, lot_id string, ts timestamp_ntz")
    orders = spark.createDataFrame([("P", "J0", 30, t, False), ("P", "J1", 5, t + dt.timedelta(days=1), False), ("P", "J2", 5, t, True)], "product string, jt_id string, qty long, due timestamp_ntz, fulfilled boolean")
    ships = spark.createDataFrame([(j, t + dt.timedelta(hours=4)) for j in ("J0", "J1", "J2")], "jt_id string, truck_time timestamp_ntz")
    got = forward.late_counts(forward.cascade(cases, lots, events, orders, shipments=ships))
    assert sorted((r.case_id, r.n_late, r.n_today, r.shortfall, r.p_late) for r in got.collect()) == [("a", 2, 1, 0.0, 1.0), ("b", 0, 0, 0.0, None)]
