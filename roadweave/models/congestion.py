"""Congestion class of a reading and class/speed forecasts, with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.functions.lookups import congestion_level
from roadweave.functions.numeric import rounded
from roadweave.models import trees as grown
from roadweave.operators.lags import with_lags, with_position
from roadweave.operators.sizing import broadcast_if_small

# rows ahead for each horizon at the ten-minute cadence of the lags
LEAD_ROWS = {"20min": 2, "30min": 3, "60min": 6}
FITS_AT_ONCE = 3
"""Each keeps its own blocks of the binned training rows."""


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep the training rows (spilling to disk) while several passes read them."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


class _Assembler(VectorAssembler):
    """Rows to fit on come with their bins and need no vector."""

    def transform(self, dataset: DataFrame, params=None) -> DataFrame:
        return dataset if grown.BINS in dataset.columns else super().transform(dataset, params)


def _binned(rows: DataFrame, features: list[str], targets: list[str]) -> tuple[DataFrame, list]:
    """``rows`` with the bins of their features, and the cuts between these.

    ``rows`` are read twice: for the cuts, which need the features only, and for the bins.
    """
    numeric = _numeric(rows, features)
    cuts = grown.thresholds(numeric, features)
    return grown.binned(numeric, features, cuts, targets), cuts


def _classifier(features: list[str], cuts: list, label: str, trees: int, depth: int, seed: int) -> Pipeline:
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")
    return Pipeline(stages=[
        index,
        _Assembler(inputCols=features, outputCol="_features"),
        grown.ClassForest(cuts, featuresCol="_features", labelCol="_label", predictionCol="_class",
                          probabilityCol="_probability", rawPredictionCol="_raw",
                          numTrees=trees, maxDepth=depth, seed=seed),
    ])


def _labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def _apply(model: PipelineModel, df: DataFrame, output: str) -> DataFrame:
    """Assembler and forest only; the label column is not needed to predict."""
    for stage in model.stages[1:]:
        df = stage.transform(df)
    return _named(model, df, output)


def _named(model: PipelineModel, df: DataFrame, output: str) -> DataFrame:
    return IndexToString(inputCol="_class", outputCol=output, labels=_labels(model)).transform(df)


def train_congestion(features: DataFrame, trees: int = 20, depth: int = 8, seed: int = 42) -> PipelineModel:
    """Forest over the 23 features.  Closed roads follow a rule and are not learned.

    ``features`` are read twice, so store them if they are costly to compute.
    """
    open_roads = features.filter(~F.coalesce("road_closure", F.lit(False)))
    labelled = open_roads.withColumn("actual_congestion", congestion_level(F.col("congestion_ratio"), F.lit(False)))
    binned, cuts = _binned(labelled, fv.CONGESTION_FEATURES, ["actual_congestion"])
    with _kept(binned) as rows:
        return _classifier(fv.CONGESTION_FEATURES, cuts, "actual_congestion", trees, depth, seed).fit(rows)


def predict_congestion(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Add ``predicted_congestion`` and ``actual_congestion``; a closure decides both."""
    closed = F.coalesce("road_closure", F.lit(False))
    scored = _apply(model, _numeric(features, fv.CONGESTION_FEATURES), "_predicted")
    kept = features.columns
    return scored.select(
        *[c for c in kept if c not in ("predicted_congestion", "actual_congestion")],
        F.when(closed, F.lit("Closed")).otherwise(F.col("_predicted")).alias("predicted_congestion"),
        congestion_level(F.col("congestion_ratio"), closed).alias("actual_congestion"))


def with_targets(readings: DataFrame, ts: str = "event_time", placed: bool = False) -> DataFrame:
    """Add ``target_speed_*`` and ``target_class_*``: the road's reading 2, 3 and 6 rows ahead.

    ``placed`` readings bring the ``position`` that ``with_lags`` gave them, and keep it.
    """
    level = readings.withColumn(
        "_level", congestion_level(F.col("congestion_ratio"), F.coalesce("road_closure", F.lit(False))))
    ahead = {}
    for horizon, rows in LEAD_ROWS.items():
        ahead[f"target_speed_{horizon}"] = ("current_speed", -rows)
        ahead[f"target_class_{horizon}"] = ("_level", -rows)
    found = with_lags(level, ["location_name"], ts, "reading_id", ahead, placed=placed).drop("_level")
    return found if placed else found.drop("position")


def time_split(rows: DataFrame, share: float = 0.5, gap_rows: int = fv.BUFFER_ROWS + max(LEAD_ROWS.values()), ts: str = "event_time",
               tie: str = "reading_id", keys: tuple[str, ...] = ("location_name",), placed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The earlier ``share`` of each road's rows, to fit on, and the later ones, to judge by.

    Between them ``gap_rows`` rows of the road are left out: as many as lags look back and targets look ahead, so that no reading
    is part of both.  ``placed`` rows have their ``position`` already, without gaps but from any number on: they stay where they are.
    """
    numbered = rows if placed else with_position(rows, list(keys), ts, tie)
    before = F.min("position") - 1
    last = numbered.groupBy(*keys).agg((before + F.floor((F.max("position") - before) * share)).alias("_cut"))
    cut = numbered.join(broadcast_if_small(last) if placed else last, list(keys))
    return (cut.filter("position <= _cut").drop("position", "_cut"),
            cut.filter(F.col("position") > F.col("_cut") + gap_rows).drop("position", "_cut"))


def train_forecasts(rows: DataFrame, trees: int = 20, depth: int = 5, seed: int = 42) -> dict:
    """Per horizon a speed regressor and a class forest over the 32 features.

    A fit is a long chain of short jobs, so ``FITS_AT_ONCE`` of the six run side by side over the same kept rows.
    ``rows`` are read twice, so store them if their features are costly to compute.
    """
    targets = [f"target_{kind}_{horizon}" for horizon in fv.HORIZON_MINUTES for kind in ("speed", "class")]
    binned, cuts = _binned(rows, fv.FORECAST_FEATURES, targets)
    with _kept(binned) as prepared:
        prepared.count()  # kept before several fits ask for it
        wanted = {}
        for horizon in fv.HORIZON_MINUTES:
            speed = f"target_speed_{horizon}"
            wanted[speed] = Pipeline(stages=[
                _Assembler(inputCols=fv.FORECAST_FEATURES, outputCol="_features"),
                grown.BoostedTrees(cuts, featuresCol="_features", labelCol=speed, predictionCol="_speed",
                                   maxIter=trees, maxDepth=depth, seed=seed),
            ])
        for horizon in fv.HORIZON_MINUTES:  # after the speeds, whose chains are longer
            level = f"target_class_{horizon}"
            wanted[level] = _classifier(fv.FORECAST_FEATURES, cuts, level, trees, depth, seed)

        def fit(target: str) -> PipelineModel:
            return wanted[target].fit(prepared.filter(F.col(target).isNotNull()))

        with ThreadPool(FITS_AT_ONCE) as pool:
            fitted = dict(zip(wanted, pool.map(inheritable_thread_target(rows.sparkSession)(fit), wanted, chunksize=1), strict=True))
    return {horizon: (fitted[f"target_speed_{horizon}"], fitted[f"target_class_{horizon}"]) for horizon in fv.HORIZON_MINUTES}


def predict_forecasts(models: dict, rows: DataFrame) -> DataFrame:
    """Add ``forecasts``: map horizon -> struct(speed, class, confidence).

    All models read the same features, so a row's vector is put together once, not once a model.
    """
    assembler = VectorAssembler(inputCols=fv.FORECAST_FEATURES, outputCol="_features")
    df, entries = assembler.transform(_numeric(rows, fv.FORECAST_FEATURES)), []
    for horizon, (speed_model, class_model) in models.items():
        df = speed_model.stages[-1].transform(df).withColumnRenamed("_speed", f"_speed_{horizon}")
        df = (
            _named(class_model, class_model.stages[-1].transform(df), f"_class_{horizon}")
            .withColumn(f"_confidence_{horizon}", F.array_max(vector_to_array("_probability")))
            .drop("_raw", "_probability", "_class")
        )
        entries += [F.lit(horizon), F.struct(
            rounded(F.col(f"_speed_{horizon}"), 1).alias("speed"),
            F.col(f"_class_{horizon}").alias("class"),
            rounded(F.col(f"_confidence_{horizon}"), 3).alias("confidence"))]
    return df.select(*rows.columns, F.create_map(*entries).alias("forecasts"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
