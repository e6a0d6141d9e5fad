"""Import of a raw file as a transaction: detect its table, map, type, validate, split, upsert into a versioned table."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotgraph.functions import values
from lotgraph.operators import mapping


@dataclass(frozen=True)
class Group:
    """A table that files can be imported into: its fields' known names, and what good rows have.

    foreign: field → name of the table whose first column has its values; listed fields hold comma-separated values.
    """

    aliases: dict[str, tuple[str, ...]]
    required: tuple[str, ...]
    key: tuple[str, ...]
    dates: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: dict[str, str] = field(default_factory=dict)
    listed: tuple[str, ...] = ()


class Staged(NamedTuple):
    """group; rows: typed fields with _row; issues: _row, column, kind; valid and invalid rows; unmapped: required fields
    that the file lacks, which make it invalid as a whole."""

    group: str
    rows: DataFrame
    issues: DataFrame
    valid: DataFrame
    invalid: DataFrame
    unmapped: list[str]


def detected(headers: list[str], groups: dict[str, Group]) -> str | None:
    return mapping.detect_group(headers, {name: (g.aliases, len(g.required)) for name, g in groups.items()})


def _typed(raw: DataFrame, group: Group, row: str) -> DataFrame:
    """_row, the fields as values, and _raw_ of the texts that were there."""
    found = {to: h for h, to in reversed(mapping.auto_map([c for c in raw.columns if c != row], group.aliases).items())}
    out = [F.col(row).alias("_row")]
    for name in group.aliases:
        text = F.nullif(F.trim(F.col(f"`{found[name]}`").cast("string")), F.lit("")) if name in found else F.lit(None).cast("string")
        value = values.timestamp(text) if name in group.dates else values.decimal(text) if name in group.numbers else text
        out += [value.alias(name), text.alias(f"_raw_{name}")]
    return raw.select(*out)


def _references(rows: DataFrame, group: Group, known: dict[str, DataFrame]) -> DataFrame:
    """_row, column, kind of values that their table does not have; values meet the table once each."""
    out = None
    for name, table in group.foreign.items():
        value = F.explode(values.listed(F.col(name))) if name in group.listed else F.col(name)
        refs = rows.where(F.col(name).isNotNull()).select("_row", value.alias("value"))
        there = known[table].select(F.col(known[table].columns[0]).cast("string").alias("value")).distinct()
        bad = refs.join(there, "value", "left_anti").select("_row", F.lit(name).alias("column"), F.lit("reference").alias("kind")).distinct()
        out = bad if out is None else out.unionByName(bad)
    return out


def stage(raw: DataFrame, groups: dict[str, Group], known: dict[str, DataFrame], row: str = "_raw_row_id", group: str | None = None) -> Staged:
    """The file's rows, typed and checked; row: the column that names a raw row, in the file's order.

    A required field that is empty is incomplete; a text that is no date, number or listed value is invalid; second and
    later rows of a key repeat it; a value that its table lacks is a bad reference.  A row with any issue is not imported.
    """
    name = group or detected([c for c in raw.columns if c != row], groups)
    if name is None:
        raise ValueError("no table has more than half of the file's columns")
    g = groups[name]
    typed = _typed(raw, g, row).checkpoint()
    headers = set(mapping.auto_map([c for c in raw.columns if c != row], g.aliases).values())
    unmapped = [c for c in g.required if c not in headers]

    def issue(column: str, kind: str, bad: Column) -> Column:
        return F.when(bad, F.struct(F.lit(column).alias("column"), F.lit(kind).alias("kind")))

    checks = [issue(c, "incomplete", F.col(f"_raw_{c}").isNull()) for c in g.required]
    checks += [issue(c, "invalid", F.col(f"_raw_{c}").isNotNull() & F.col(c).isNull()) for c in (*g.dates, *g.numbers)]
    checks += [issue(c, "invalid", F.col(c).isNotNull() & ~F.col(c).isin(*allowed)) for c, allowed in g.enums.items()]
    own = typed.select("_row", F.explode(F.array_compact(F.array(*checks))).alias("i")).select("_row", "i.column", "i.kind")
    whole = F.lit(True)
    for c in g.key:
        whole = whole & F.col(c).isNotNull()
    place = F.row_number().over(Window.partitionBy(*g.key).orderBy("_row"))
    again = typed.where(whole).withColumn("_n", place).where("_n > 1").select("_row", F.lit(",".join(g.key)).alias("column"), F.lit("repeated").alias("kind"))
    issues = own.unionByName(again)
    bad_refs = _references(typed, g, known)
    issues = (issues if bad_refs is None else issues.unionByName(bad_refs)).checkpoint()
    rows = typed.select("_row", *g.aliases)
    bad = issues.select("_row").distinct()
    return Staged(name, rows, issues, rows.join(bad, "_row", "left_anti"), rows.join(bad, "_row", "left_semi"), unmapped)


def summary(staged: Staged) -> DataFrame:
    """One row: group, state (invalid, partly valid or valid), n_valid, n_invalid, n_issues."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(staged.valid, "n_valid").crossJoin(n(staged.invalid, "n_invalid")).crossJoin(n(staged.issues, "n_issues"))  # one row each
    state = F.when(F.lit(bool(staged.unmapped)) | (F.col("n_valid") == 0), "invalid").when(F.col("n_invalid") > 0, "partly valid").otherwise("valid")
    return out.select(F.lit(staged.group).alias("group"), state.alias("state"), "n_valid", "n_invalid", "n_issues")


def merged(old: DataFrame, staged: Staged, key: tuple[str, ...]) -> DataFrame:
    """old with the valid rows: known keys take their fields, new ones are added; other columns of old stay."""
    new = staged.valid.drop("_row").withColumn("_new", F.lit(True))
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    pick = lambda c: F.when(F.col("n._new"), F.col(f"n.{c}").cast(old.schema[c].dataType)).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return old.alias("o").join(new.alias("n"), condition, "full_outer").select(*[pick(c).alias(c) for c in old.columns])


class VersionedTable:
    """Whole versions of a table under one folder, each a Parquet folder, and a log with a row for each.

    A version counts from the moment its log row is there, so a run that dies before leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        schema = "version long, file string, state string, n_valid long, n_invalid long, n_issues long"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log").getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log"))
        return self.spark.read.schema(schema).parquet(f"{self.root}/log") if there else self.spark.createDataFrame([], schema)

    def version(self) -> int | None:
        return self.log().agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/version={self.version() if version is None else version}")

    def issues(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/issues/version={version}")

    def _done(self, version: int, file: str, row: DataFrame) -> int:
        row.select(F.lit(version).cast("long").alias("version"), F.lit(file).alias("file"), "state", "n_valid", "n_invalid", "n_issues").coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return version

    def create(self, rows: DataFrame) -> int:
        rows.write.mode("overwrite").parquet(f"{self.root}/version=0")
        return self._done(0, "", rows.agg(F.lit("valid").alias("state"), F.count(F.lit(1)).alias("n_valid"), F.lit(0).cast("long").alias("n_invalid"), F.lit(0).cast("long").alias("n_issues")))

    def commit(self, staged: Staged, group: Group, file: str) -> int:
        """The next version with the valid rows and the issues beside it; an invalid file changes nothing and raises."""
        state = summary(staged).checkpoint()
        if state.first().state == "invalid":
            raise ValueError(f"{file} has no valid rows" if not staged.unmapped else f"{file} lacks {', '.join(staged.unmapped)}")
        at = self.version()
        staged.issues.write.mode("overwrite").parquet(f"{self.root}/issues/version={at + 1}")
        merged(self.read(at), staged, group.key).write.mode("overwrite").parquet(f"{self.root}/version={at + 1}")
        return self._done(at + 1, file, state)
