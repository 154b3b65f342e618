"""Stored tables: date-partitioned Parquet, appended by jobs and replaced by batch id or date."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roadweave import schemas


def with_event_date(df: DataFrame, time_column: str) -> DataFrame:
    return df.withColumn("event_date", F.to_date(time_column))


def append_table(df: DataFrame, root: str, table: str) -> None:
    """Append rows to a date-partitioned table.

    Rows are brought together by date (and spread inside it) so that a job writes few, large
    files per date instead of one per task and date; ``rebalance`` splits a hot date again.
    """
    dated = with_event_date(df, schemas.TABLE_TIME[table]).hint("rebalance", "event_date")
    dated.write.mode("append").partitionBy("event_date").parquet(f"{root}/{table}")


def read_table(spark: SparkSession, root: str, table: str, since_date: date | None = None) -> DataFrame:
    """Read a table; ``since_date`` prunes partitions before any file is opened."""
    df = spark.read.parquet(f"{root}/{table}")
    return df if since_date is None else df.filter(F.col("event_date") >= F.lit(since_date))


def replace_batch(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Write one micro-batch under its id, split by date; a repeated batch replaces itself whole."""
    (
        with_event_date(df, schemas.TABLE_TIME[table]).hint("rebalance", "event_date")
        .write.mode("overwrite").partitionBy("event_date").parquet(f"{root}/{table}/batch_id={batch_id}")
    )


def write_version(df: DataFrame, root: str, table: str, version: int) -> None:
    """Write a whole new version of a small table; those more than two numbers back are removed."""
    df.write.mode("overwrite").parquet(f"{root}/{table}/version={version}")
    spark = df.sparkSession
    for old in versions(spark, root, table):
        if old < version - 2:
            _folder(spark, f"{root}/{table}/version={old}").delete()


def versions(spark: SparkSession, root: str, table: str) -> list[int]:
    """Complete versions of a table, in order."""
    found = _folder(spark, f"{root}/{table}").children()
    names = [name for name in found if name.startswith("version=")]
    return sorted(int(name.split("=")[1]) for name in names if _folder(spark, f"{root}/{table}/{name}/_SUCCESS").exists())


def read_version(spark: SparkSession, root: str, table: str, schema: StructType | str | None = None, upto: int | None = None) -> DataFrame:
    """The newest complete version of a table (none newer than ``upto``); without any, an empty table of ``schema``."""
    known = [v for v in versions(spark, root, table) if upto is None or v <= upto]
    if not known:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{table}/version={known[-1]}")


class _folder:
    """A path in whatever file system it belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.system.exists(self.path)

    def children(self) -> list[str]:
        return [s.getPath().getName() for s in self.system.listStatus(self.path)] if self.exists() else []

    def delete(self) -> None:
        self.system.delete(self.path, True)


def save_mart(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}")


CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"
"""Times keep their microseconds; times with less are read too."""


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, timestampFormat=CSV_TIME)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


# exports -----------------------------------------------------------------------------


def export_warehouse(tables: dict[str, DataFrame], database: str, day: date,
                     location: str | None = None) -> dict[str, tuple[int, int]]:
    """Write every table under partition ``ds`` of its export table (database files at ``location``).

    Returns ``name -> (rows in the source, rows in the export)``; a difference raises.  The
    source count is taken while writing, so the source is read once.
    """
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))
    counts = {}
    for name, df in tables.items():
        seen = Observation(f"export_{name}")
        target = f"{database}.{name}"
        dated = df.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("ds", F.lit(day.isoformat()))
        if spark.catalog.tableExists(target):
            spark.sql(f"ALTER TABLE {target} DROP IF EXISTS PARTITION (ds = '{day.isoformat()}')")
        dated.write.mode("append").format("parquet").partitionBy("ds").saveAsTable(target)
        exported = spark.table(target).filter(F.col("ds") == day.isoformat()).count()
        counts[name] = (seen.get["rows"], exported)
    wrong = {n: c for n, c in counts.items() if c[0] != c[1]}
    if wrong:
        raise RuntimeError(f"export is incomplete: {wrong}")
    return counts


def expire_exports(spark: SparkSession, database: str, as_of: date, days: int = 30) -> list[str]:
    """Drop export partitions older than ``days``; returns what was dropped.

    Works on the partition list of the catalog, never on rows.  The catalog lists temporary views too; they, stored views
    and tables that are not partitioned by ``ds`` are none of ours.
    """
    oldest, dropped = (as_of - timedelta(days=days)).isoformat(), []
    for table in spark.catalog.listTables(database):
        name = f"{database}.`{table.name}`"
        if table.isTemporary or table.tableType == "VIEW" or [c.name for c in spark.catalog.listColumns(name) if c.isPartition] != ["ds"]:
            continue
        held = spark.sql(f"SHOW PARTITIONS {name}").select(F.substring_index("partition", "=", -1).alias("ds"))
        for (ds,) in held.where(F.col("ds") < oldest).sort("ds").toLocalIterator():
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (ds = '{ds}')")
            dropped.append(f"{table.name}/ds={ds}")
    return dropped


# checks ------------------------------------------------------------------------------


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def orphans(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Fact rows whose foreign key is set and has no dimension row."""
    return fact.filter(F.col(key).isNotNull()).join(dimension.select(key), key, "left_anti")


def constraint_report(
    fact: DataFrame, dimensions: dict[str, tuple[DataFrame, str, list[str], list[str]]]
) -> DataFrame:
    """Violations per rule: ``name -> (dimension, surrogate key, natural key, required columns)``."""
    parts = []

    def add(rule, df):
        parts.append(df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations"))

    for name, (dim, surrogate, natural, required) in dimensions.items():
        add(f"{name}.unique", repeated_keys(dim, natural))
        missing = F.lit(False)
        for column in required:
            missing = missing | F.col(column).isNull()
        add(f"{name}.not_null", dim.filter(missing))
        add(f"fact.{surrogate}.exists", orphans(fact, dim, surrogate))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
             for n, df in tables.items()]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
