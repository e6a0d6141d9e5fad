"""Causes of lots that carry their candidates as columns: as the general operators find them, with few rows shuffled."""

import datetime as dt

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lotgraph.operators import backward
from lotgraph.plans import engines

SF = "/root/testdata/sf0.001"
OF = {"SHIFT": "shift", "MACHINE": "station", "MATERIAL": "mat_lot", "BATCH": "jt_id"}


def test_as_the_general_operators(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(f"L{k}", k // 3, 5 + k % 2 if k % 7 else None, 9 if k < 8 else k % 4, k % 3, t + dt.timedelta(hours=5 * k), k % 4 == 0) for k in range(20)]
    lots = spark.createDataFrame(rows, "lot_id string, jt_id long, station long, mat_lot long, shift int, ts timestamp_ntz, is_ng boolean")
    cases = lots.where("is_ng").withColumn("case_id", F.col("jt_id")).dropDuplicates(["case_id"])
    cases = spark.createDataFrame(cases.collect(), cases.schema)
    touched = backward.members(lots.select(F.concat(F.lit("BATCH-"), "jt_id").alias("parent"), F.col("lot_id").alias("child")), lots.select("lot_id", F.col("station").alias("station_id"), "ts"), lots.select("lot_id", "mat_lot"), lots.select("lot_id", F.concat(F.lit("CA"), "shift").alias("shift")))
    tables = backward.flat_tables(lots, OF)
    named = engines._named
    values = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert values(named(tables), "kind", "candidate", *"abcd") == values(backward.contingency(touched, lots), "kind", "candidate", *"abcd")
    for limit in (backward.BROADCAST_ROWS, 0):
        backward.BROADCAST_ROWS, kept = limit, backward.BROADCAST_ROWS
        found = backward.flat_rows(cases, tables, OF, ["ts", "lot_id"])
        ours = values(named(backward.flat_containment(found, lots)), "case_id", "kind", "candidate", "n_isolated", "n_baseline")
        backward.BROADCAST_ROWS = kept
        best = cases.select("case_id", "lot_id").join(touched, "lot_id").select("case_id", "lot_id", "kind", "candidate")
        assert ours == values(backward.containment(best, touched, lots.select("lot_id", F.col("station").alias("station_id"), "ts")), "case_id", "kind", "candidate", "n_isolated", "n_baseline")


def shuffled(spark, query):
    """Records that a query's stages write to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(lambda k: every.apply(k), range(every.size()))}
    every = store.stageList(None, False, False, none, None)
    before = set(stages())
    query(spark, SF).write.format("noop").mode("overwrite").save()
    every = store.stageList(None, False, False, none, None)
    return sum(n for k, n in stages().items() if k not in before)


def test_lots_and_candidates_are_not_shuffled(spark):
    items = pq.ParquetFile(f"{SF}/lineitem.parquet").metadata.num_rows
    assert shuffled(spark, engines.Q["candidates"]) < 3 * items
    assert shuffled(spark, engines.Q["fisher_lift"]) < 5 * items
    assert shuffled(spark, engines.Q["containment"]) < 8 * items
