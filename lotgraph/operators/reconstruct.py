"""Canonical builders: dedupe, allocation, bill of materials, genealogy, conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgraph.operators.cuts import cut
from lotgraph.operators.running import ranges_of, running

STRETCH = 65_536  # pieces of running quantity that are swept at once


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in a stated total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def fifo(orders: DataFrame, lots: DataFrame) -> DataFrame:
    """product, jt_id, lot_id, take: supply by created order meets demand by due order, lots and orders split freely.

    orders: product, jt_id, qty, due; lots: product, lot_id, qty, created.  Both sides become running quantities; the
    boundaries of both are swept together (no pairs are formed), and the piece between neighbouring boundaries belongs to
    the next order and the next lot.  Rows without quantity take no part.  Sums and sweeps go by ranges of days and of
    quantity, so a product may hold most of the rows.
    """
    def ends(df: DataFrame, time: str, key: str) -> DataFrame:
        return running(df.where("product is not null and qty > 0"), ["product"], ranges_of(df, time), [F.col(time), F.col(key)], {"hi": ("sum", F.col("qty"))})

    none = F.lit(None)
    o = ends(orders, "due", "jt_id").select("product", "hi", "jt_id", none.cast("string").alias("lot_id"))
    s = ends(lots, "created", "lot_id").select("product", "hi", none.cast(orders.schema["jt_id"].dataType).alias("jt_id"), F.col("lot_id").cast("string").alias("lot_id"))
    points = o.unionByName(s).withColumn("at", F.floor(F.col("hi") / STRETCH)).repartition("product", "at")
    points = cut(points.groupBy("product", "at", "hi").agg(F.max("jt_id").alias("jt_id"), F.max("lot_id").alias("lot_id")))
    # a stretch is swept by itself, both ways after one exchange; what lies beside it comes from the stretches' totals
    stretch, every = Window.partitionBy("product", "at"), Window.partitionBy("product")
    sides = [Window.unboundedPreceding, -1]
    least = {c: F.min(F.when(F.col(c).isNotNull(), F.struct("hi", c)))[c] for c in ("jt_id", "lot_id")}
    totals = points.groupBy("product", "at").agg(F.max("hi").alias("_hi"), *[x.alias(f"_{c}") for c, x in least.items()])
    beside = totals.select("product", "at", F.max("_hi").over(every.orderBy("at").rowsBetween(*sides)).alias("_low"), *[F.last(f"_{c}", True).over(every.orderBy(F.desc("at")).rowsBetween(*sides)).alias(f"_{c}") for c in least])
    low = points.withColumn("low", F.max("hi").over(stretch.orderBy("hi").rowsBetween(*sides)))
    swept = low.withColumns({c: F.last(c, True).over(stretch.orderBy(F.desc("hi")).rowsBetween(Window.unboundedPreceding, 0)) for c in least}).join(beside, ["product", "at"])
    swept = swept.withColumns({"low": F.coalesce("low", "_low"), **{c: F.coalesce(c, f"_{c}") for c in least}})
    swept = swept.select("product", "jt_id", "lot_id", (F.col("hi") - F.coalesce("low", F.lit(0))).alias("take"))
    return swept.where("jt_id is not null and lot_id is not null and take > 0")


def overlay(fifo_rows: DataFrame, confirmed: DataFrame, key: str = "lot_id") -> DataFrame:
    """Confirmed rows win over computed ones of the same key."""
    return fifo_rows.join(confirmed.select(key).distinct(), key, "left_anti").withColumn("origin", F.lit("fifo")).unionByName(confirmed.withColumn("origin", F.lit("confirmed")))


def allocation_check(orders: DataFrame, allocated: DataFrame, tolerance: int = 5) -> DataFrame:
    """jt_id, qty, allocated, diff of orders whose allocation is off by more than the tolerance."""
    total = allocated.groupBy("jt_id").agg(F.sum("take").alias("allocated"))
    out = orders.join(total, "jt_id", "left").select("jt_id", "qty", F.coalesce("allocated", F.lit(0)).alias("allocated"))
    return out.withColumn("diff", F.col("allocated") - F.col("qty")).where(F.abs("diff") > tolerance)


def bom_explode(lots: DataFrame, bom: DataFrame, material: DataFrame) -> DataFrame:
    """lot_id, component, mat_lot, qty: each component from its oldest material lot (which is never used up)."""
    oldest = first_per_key(material, ["component"], [F.asc("received"), F.asc("mat_lot")]).select("component", "mat_lot")
    return lots.select("lot_id", "product", "qty").join(bom, "product").join(oldest, "component").select("lot_id", "component", "mat_lot", (F.col("qty") * F.col("per_unit") * F.col("scrap")).alias("qty"))


def fill_missing_lots(lots: DataFrame, edges: DataFrame) -> DataFrame:
    """Lots that only the genealogy names, with null fields and low confidence."""
    named = edges.select(F.col("parent").alias("lot_id")).union(edges.select("child")).where("lot_id is not null").distinct()
    missing = named.join(lots.select("lot_id"), "lot_id", "left_anti")
    return lots.unionByName(missing.withColumn("confidence", F.lit(0.5)), allowMissingColumns=True)


def edges_from_scans(scans: DataFrame, batches: DataFrame) -> DataFrame:
    """parent, child, edge_type, confidence: stated by SPLIT and MERGE scans, else inferred from a lot's batch."""
    direct = scans.where(F.col("scan_type").isin("SPLIT", "MERGE") & F.col("parent").isNotNull()).select("parent", "child", F.col("scan_type").alias("edge_type"), F.lit(1.0).alias("confidence")).dropDuplicates(["parent", "child"])
    guess = batches.where("batch is not null").select(F.col("batch").alias("parent"), F.col("lot_id").alias("child"), F.lit("SPLIT").alias("edge_type"), F.lit(0.75).alias("confidence")).dropDuplicates(["parent", "child"])
    return direct.unionByName(guess.join(direct.select("parent", "child"), ["parent", "child"], "left_anti"))


def conservation(edges: DataFrame, lots: DataFrame, tolerance: float = 5) -> DataFrame:
    """parent, parent_qty, child_qty, n_children, diff of splits that do not add up; edges: parent, child_qty."""
    total = edges.groupBy("parent").agg(F.sum("child_qty").alias("child_qty"), F.count(F.lit(1)).alias("n_children"))
    out = total.join(lots.select(F.col("lot_id").alias("parent"), F.col("qty").alias("parent_qty")), "parent", "left").where("parent_qty > 0")
    return out.withColumn("diff", F.col("child_qty") - F.col("parent_qty")).where(F.abs("diff") > tolerance)
