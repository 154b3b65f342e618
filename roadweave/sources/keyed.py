"""Tables with one row or a short list of rows per key, changed batch by batch, and the commit record of a batch.

Keys are dealt into hashed buckets.  A batch writes new versions of the buckets its keys fall into and of no others; which
version of a bucket counts is part of the record that commits the batch.  Until the record is there, readers see all tables
as they were; a batch that is repeated starts from the record before it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.sources.tables import _folder, read_version, write_version

BUCKETS = 64


@dataclass
class Commit:
    """What readers may see: rows of batches up to ``batch``, and a version of each bucket of each keyed table."""

    batch: int = -1
    buckets: dict[str, dict[str, int]] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)
    replaced: list[list] = field(default_factory=list)

    def following(self, batch: int) -> Commit:
        """A record for the next batch, to be changed as its tables are written."""
        return Commit(batch, {table: dict(held) for table, held in self.buckets.items()}, dict(self.notes))


def read_commit(spark: SparkSession, root: str, upto: int | None = None) -> Commit:
    """The newest record, none newer than ``upto``; without any, an empty one."""
    row = read_version(spark, root, "commits", "record string", upto).first()
    return Commit(**json.loads(row["record"])) if row else Commit()


def write_commit(spark: SparkSession, root: str, commit: Commit, before: Commit) -> None:
    """Make a batch visible; bucket versions that the batch before replaced can no longer be asked for and go."""
    commit.replaced = [[table, bucket, version] for table, held in before.buckets.items() for bucket, version in held.items()
                       if commit.buckets[table].get(bucket) != version]
    write_version(spark.createDataFrame([(json.dumps(commit.__dict__),)], "record string").coalesce(1), root, "commits", commit.batch)
    for table, bucket, version in before.replaced:
        _folder(spark, f"{root}/{table}/version={version}/bucket={bucket}").delete()


def bucket_of(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class KeyedTable:
    """A table of rows by ``keys``, below ``root``."""

    def __init__(self, root: str, name: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.root, self.name, self.keys, self.schema, self.buckets = root, name, keys, schema, buckets

    def read(self, spark: SparkSession, commit: Commit, only: list[int] | None = None) -> DataFrame:
        """All rows that ``commit`` makes visible, or those of some buckets; no other file is opened."""
        held = commit.buckets.get(self.name, {})
        paths = [f"{self.root}/{self.name}/version={version}/bucket={bucket}" for bucket, version in sorted(held.items())
                 if only is None or int(bucket) in only]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def touched(self, changed: DataFrame) -> list[int]:
        """Buckets that the keys of ``changed`` fall into: at most as many numbers as there are buckets."""
        return [r[0] for r in changed.select(bucket_of(*self.keys, buckets=self.buckets)).distinct().collect()]

    def write(self, rows: DataFrame, touched: list[int], commit: Commit) -> None:
        """The whole new content of the touched buckets, visible once ``commit`` (of this batch) is written."""
        path = f"{self.root}/{self.name}/version={commit.batch}"
        dealt = rows.select(*rows.columns, bucket_of(*self.keys, buckets=self.buckets).alias("bucket"))
        # as many tasks as there are rows for; each bucket's rows lie together
        dealt.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        empty = set(touched) - {int(name.split("=")[1]) for name in _folder(rows.sparkSession, path).children() if name.startswith("bucket=")}
        held = {b: v for b, v in commit.buckets.get(self.name, {}).items() if int(b) not in empty}
        commit.buckets[self.name] = held | {str(b): commit.batch for b in touched if b not in empty}


def committed(spark: SparkSession, root: str, table: str, commit: Commit | None = None) -> DataFrame:
    """Rows of a table written by batches (``replace_batch``), without those of a batch that is not committed."""
    last = (commit or read_commit(spark, root)).batch
    return spark.read.parquet(f"{root}/{table}").where(F.col("batch_id") <= last)
