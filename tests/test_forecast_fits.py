"""Forecast models are fitted side by side, each on the rows that have its target."""

import threading

from pyspark.sql import functions as F

from roadweave import fixed_values as fv
from roadweave.models import congestion


def test_fits_run_side_by_side_on_their_rows(spark, monkeypatch):
    meeting = threading.Barrier(congestion.FITS_AT_ONCE, timeout=120)

    def fit(pipeline, rows):
        meeting.wait()  # breaks if fits come one after the other
        return rows.count()

    monkeypatch.setattr(congestion.Pipeline, "fit", fit)
    rows = spark.range(40).select(
        *[F.col("id").cast("double").alias(c) for c in fv.FORECAST_FEATURES],
        *[F.when(F.col("id") % 8 > i, F.col("id").cast("double")).alias(f"target_speed_{h}") for i, h in enumerate(fv.HORIZON_MINUTES)],
        *[F.when(F.col("id") % 10 > i, F.lit("Low")).alias(f"target_class_{h}") for i, h in enumerate(fv.HORIZON_MINUTES)])
    assert list(congestion.train_forecasts(rows).values()) == [(35, 36), (30, 32), (25, 28)]
