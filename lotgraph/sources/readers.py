"""Raw scans: all text, only the empty field is null, every row with its file and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lotgraph.schemas import SOURCES, Source


def csv_text(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """CSV as text columns without inference; a byte order mark before the first header is dropped."""
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
    df = df.select([F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c.lstrip("﻿").strip()) for c in df.columns])
    return df.withColumn("_source_file", F.col("_metadata.file_name"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Sheets or drifted files one under the other by column name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_row_ids(df: DataFrame) -> DataFrame:
    """_raw_row_id as file stem and place within the file, _ingested_at."""
    stem = F.regexp_replace("_source_file", r"\.[^.]*$", "")
    place = F.row_number().over(Window.partitionBy("_source_file").orderBy("_at")) - 1
    out = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_raw_row_id", F.concat_ws("_", stem, F.format_string("%06d", place)))
    return out.drop("_at").withColumn("_ingested_at", F.current_timestamp())


def raw(spark: SparkSession, root: str, source: str, registry: dict[str, Source] = SOURCES) -> DataFrame:
    """One registered source; Spark raises if no file matches its glob."""
    s = registry[source]
    return with_row_ids(csv_text(spark, f"{root}/{s.glob}", s.sep))


def audit(df: DataFrame) -> DataFrame:
    """rows, columns and files of a raw source."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.count_distinct("_source_file").alias("n_files"))


def typed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Master data with a stated schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}.parquet") for n in names}


def row_hash(df: DataFrame) -> DataFrame:
    """_row_hash: 12 hex digits of the row's values."""
    return df.withColumn("_row_hash", F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])), 1, 12))


def dispatch(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """Files of one kind, told by the first one's suffix: CSV as text, sheets saved as CSV, JSON or Parquet."""
    kind = paths[0].rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt"):
        return csv_text(spark, paths, sep)
    if kind == "json":
        return spark.read.option("multiLine", True).json(paths)
    if kind == "parquet":
        return spark.read.parquet(*paths)
    raise ValueError(f"no reader for .{kind} files; save the sheets of a workbook as CSV")


def sheets(spark: SparkSession, paths: dict[str, str], sep: str = ",") -> DataFrame:
    """The sheets of a workbook, saved as CSV, one under the other by column name, with _source_sheet."""
    return union_all([csv_text(spark, path, sep).withColumn("_source_sheet", F.lit(name)) for name, path in paths.items()])


def config(spark: SparkSession, path: str) -> dict[str, str]:
    """A small configuration file of sections and keys (``section:``, then indented ``key: value``) as section.key."""
    out, section = {}, ""
    for row in spark.read.text(path).collect():  # a file of settings
        line = row.value.split("#")[0].rstrip()
        key, mark, value = line.strip().partition(":")
        if not mark:
            continue
        if not line[0].isspace():
            section = "" if value.strip() else key + "."
        if value.strip():
            out[(section if line[0].isspace() else "") + key] = value.strip()
    return out
