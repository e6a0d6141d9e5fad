"""Sinks: Parquet layers, JSON results, CSV reports, GraphML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet_layer(frames: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None) -> None:
    for name, df in frames.items():
        seen: dict[str, None] = dict.fromkeys(df.columns)
        writer = df.select(*seen).write.mode("overwrite")
        if cols := (partition_by or {}).get(name):
            writer = writer.partitionBy(*cols)
        writer.parquet(f"{root}/{name}.parquet")


def json_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def verify(spark: SparkSession, root: str, schemas: dict[str, StructType]) -> DataFrame:
    """table, n_rows, missing: row counts and the columns that a layer's tables lack."""
    out = None
    for name, schema in schemas.items():
        df = spark.read.parquet(f"{root}/{name}.parquet")
        missing = ",".join(c for c in schema.names if c not in df.columns)
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.lit(missing).alias("missing"))
        out = row if out is None else out.unionByName(row)
    return out


def graphml(edges: DataFrame, path: str, parent: str = "parent_lot_id", child: str = "child_lot_id", kind: str = "edge_type") -> None:
    """Edges as GraphML elements, a file per partition, between a head and a tail file."""
    text = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    line = F.format_string('<edge source="%s" target="%s"><data key="kind">%s</data></edge>', text(parent), text(child), text(kind))
    edges.select(line.alias("value")).write.mode("overwrite").text(f"{path}/1-edges")
    spark = edges.sparkSession
    for name, value in (("0-head", '<graphml><key id="kind" for="edge"/><graph edgedefault="directed">'), ("2-tail", "</graph></graphml>")):
        spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def reports(root: str, impacts: DataFrame, linked: DataFrame, issues: DataFrame, lots: DataFrame, exported_at: str) -> None:
    """Four CSV reports: incidents with their orders, orders at risk, issues of data quality, normalised lots.

    Each row says what kind of data it is: piloted where keys state the link, else inferred or a forecast.  impacts:
    incident_id and more; linked: incident_id, jt_id, link, short; issues and lots as they are.
    """
    kind = F.when(F.col("link") == "confirmed", "pilot").when(F.col("link") == "inferred", "inferred").otherwise("not linked")
    stamp = F.lit(exported_at).alias("exported_at")
    both = impacts.join(linked, "incident_id", "left")
    csv_report(both.select(*impacts.columns, "jt_id", "link", kind.alias("data_kind"), stamp), f"{root}/incidents")
    risk = linked.where("short > 0").select("jt_id", "incident_id", F.round("short").alias("short"), "link", F.concat(F.lit("forecast/"), kind).alias("data_kind"), stamp)
    csv_report(risk, f"{root}/orders_at_risk")
    csv_report(issues.select("*", stamp), f"{root}/data_quality")
    csv_report(lots.select("*", F.lit("pilot").alias("data_kind"), stamp), f"{root}/lots")


def markdown(impacts: DataFrame, path: str, key: str = "case_id", title: str = "Impact of") -> None:
    """A Markdown section per row of impacts: its values as a table; one text line per line."""
    others = [c for c in impacts.columns if c != key]
    cell = lambda c: F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("not known")), F.lit(" |"))
    text = F.concat_ws("\n", F.concat(F.lit(f"# {title} "), F.col(key).cast("string")), F.lit(""), F.lit("| what | value |"), F.lit("|-|-|"), *[cell(c) for c in others], F.lit(""))
    impacts.select(text.alias("value")).write.mode("overwrite").text(path)


def dashboard_export(forward: DataFrame, backward: DataFrame, path: str) -> None:
    """One JSON document per case: its impact and its ranked causes, as a page shows them."""
    causes = backward.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "candidate", "score"))).alias("causes"))  # a few ranks
    forward.join(causes, "case_id", "left").write.mode("overwrite").json(path)
