"""Helpers shared by the corpus operators: session, stored intermediate tables, text blocks for numpy."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from roadweave.session import checkpoint_dir

BATCH_ROWS = 1000


def corpus_session(spark: SparkSession) -> SparkSession:
    """Settings that texts need: adaptive plans and Arrow batches of few rows, as one text may be long."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return corpus_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write `df` once below the shared checkpoint folder and read it back: lineage ends here.

    Unlike a checkpoint of rows, the table keeps its columns apart and its size known, so later joins are planned
    on real sizes. A lost executor costs nothing that is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_results(df: DataFrame, inputs: list[str], added: list[StructField], work: Callable) -> DataFrame:
    """Columns of `df` as they are, and those that `work` makes of each Arrow batch of the `inputs` (as lists).

    A column of `df` with the name of an added one is replaced.
    """
    replaced = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in replaced]
    columns = [F.col(f"`{f.name}`") for f in kept] + [F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)]
    kinds = [to_arrow_type(f.dataType) for f in added]
    names = [f.name for f in kept] + [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(*[batch.column(len(kept) + i).to_pylist() for i in range(len(inputs))])
            arrays = [pa.array(values, kind, from_pandas=True) for values, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=names)

    return df.select(*columns).mapInArrow(run, StructType([*kept, *added]))


def bucket_of(column: str | Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo `modulus`; a null id counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def blocks(texts: list[str], most_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `most_chars` together; a longer text is a range of its own."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > most_chars:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def code_points(texts: list[str], gap: str = "\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, joined by one `gap`, with start and end of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    joined = np.frombuffer(gap.join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return joined, starts, starts + lengths


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit hashes."""
    hashes = (hashes ^ (hashes >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    hashes ^= hashes >> np.uint32(13)
    return hashes * np.uint32(0xC2B2AE35)


def gram_buckets(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position but the last n - 1."""
    size = len(points) - n + 1
    if size <= 0:
        return np.empty(0, np.uint32)
    hashes = np.full(size, (0x9E3779B1 * n) & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        hashes = (hashes ^ points[i : i + size]) * np.uint32(0x01000193)
        hashes ^= hashes >> np.uint32(15)
    return mixed(hashes) >> np.uint32(32 - bits)


def range_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end], along the first axis; 0 for empty ranges."""
    shape = (len(starts), *values.shape[1:])
    if not len(values):
        return np.zeros(shape, values.dtype)
    cuts = np.minimum(np.stack([starts, np.maximum(starts, ends)], 1).ravel(), len(values) - 1)
    sums = np.add.reduceat(values, cuts, axis=0)[::2]
    # a range that reaches the last value loses it to the cut above
    reach = (ends >= len(values)) & (starts < len(values) - 1) & (ends > starts)
    sums[reach] += values[-1]
    sums[ends <= starts] = 0
    return sums
