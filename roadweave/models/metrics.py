"""Model quality as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions.numeric import rounded


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R2 over rows where both values are present; one pass."""
    known = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    error = F.col(predicted) - F.col(actual)
    n, total = F.count(F.lit(1)), F.var_pop(actual) * F.count(F.lit(1))
    return known.groupBy(*(by or [])).agg(
        n.alias("n"),
        rounded(F.avg(F.abs(error)), 4).alias("mae"),
        rounded(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        rounded(1 - F.sum(error * error) / F.nullif(total, F.lit(0.0)), 4).alias("r2"),
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy, weighted and macro F1.

    The readings are counted into the confusion table once; precision and recall come from it.
    """
    confusion = (
        df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    )
    # one row for the actual side and one for the predicted side of every cell
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("a").alias("level"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("level"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")))).alias("s")).select("s.*")
    by_level = sides.groupBy("level").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    f1 = 2 * F.col("hits") / (F.col("actual") + F.col("predicted"))
    return by_level.withColumn("f1", f1).agg(
        F.sum("actual").alias("n"),
        rounded(F.sum("hits") / F.sum("actual"), 4).alias("accuracy"),
        rounded(F.sum(F.col("f1") * F.col("actual")) / F.sum("actual"), 4).alias("f1_weighted"),
        rounded(F.avg("f1"), 4).alias("f1_macro"),
    )
