"""How the domain's tables are bound to the driver's tables, for Spark and, as named SQL parts, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lots(spark: SparkSession, sf: str) -> DataFrame:
    """A lot is what one (order, line) holds."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("product"))
    out = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "l_linenumber").agg(F.min("product").alias("product"), F.min("l_suppkey").alias("station"), F.min("l_partkey").alias("mat_lot"), F.floor(F.sum("l_quantity")).alias("qty"), F.min("l_shipdate").alias("created"), F.bool_or(F.col("l_returnflag") == "R").alias("is_ng"))
    return out.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("lot_id"), F.col("l_orderkey").alias("jt_id"), "product", "station", "mat_lot", "qty", "created", "is_ng")


def orders(spark: SparkSession, sf: str, own: DataFrame | None = None) -> DataFrame:
    """A job ticket is an order, its product the least of its lots'; own: the lots, if they are at hand."""
    product = (lots(spark, sf) if own is None else own).groupBy("jt_id").agg(F.min("product").alias("product"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("jt_id"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), (20 + F.col("o_orderkey") % 50).alias("qty"), F.col("o_orderdate").alias("due"), F.col("o_orderstatus").alias("status"))
    return o.join(product, "jt_id")


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """An incident is an error event; it lasts 1 to 12 hours."""
    e = table(spark, sf, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("case_id"), F.col("user_id").alias("station_id"), F.col("ts").alias("start_ts"), (1 + F.col("event_id") % 12).alias("hours"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """A process parameter is a user's event values in order of time."""
    return table(spark, sf, "events").select(F.col("user_id").alias("series"), F.struct("ts", "event_id").alias("ord"), "value")


PARTS = {
    "lots": """lots AS (SELECT l_orderkey || '-' || l_linenumber AS lot_id, l_orderkey AS jt_id, min(p_brand || ' ' || p_type) AS product, min(l_suppkey) AS station,
  min(l_partkey) AS mat_lot, floor(sum(l_quantity))::BIGINT AS qty, min(l_shipdate) AS created, bool_or(l_returnflag = 'R') AS is_ng
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber)""",
    "jt": """jt AS (SELECT o_orderkey AS jt_id, o_custkey AS customer, o_orderpriority AS priority, 20 + o_orderkey % 50 AS qty, o_orderdate AS due, o_orderstatus AS status, product
  FROM orders JOIN (SELECT jt_id, min(product) AS product FROM lots GROUP BY jt_id) p ON o_orderkey = p.jt_id)""",
    "inc": "inc AS (SELECT event_id AS case_id, user_id AS station_id, ts AS start_ts, 1 + event_id % 12 AS hours FROM events WHERE event_type = 'error')",
    "ser": "ser AS (SELECT user_id AS series, ts, event_id, value FROM events)",
    "base": """base AS (SELECT series, value, row_number() OVER o - 1 AS i, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n, ts, event_id
  FROM ser WHERE value IS NOT NULL AND NOT isnan(value) WINDOW w AS (PARTITION BY series), o AS (PARTITION BY series ORDER BY ts, event_id))""",
}


def sql(parts: str, body: str, recursive: bool = False) -> str:
    """WITH the named parts, then the body, which may go on with more parts after a comma."""
    named = ",\n".join(PARTS[p] for p in parts.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{named}{body if body.lstrip().startswith(',') else chr(10) + body}"
