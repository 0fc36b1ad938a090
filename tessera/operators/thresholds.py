"""Thresholds fitted on one split and applied unchanged to all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_thresholds(rows: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: each name's exact quantile (linear interpolation) of a column.

    The aggregate holds a count per distinct value, not per row: box ratios lie on a pixel grid, so their number is
    bounded by image sizes. Values without such a bound should be quantised first.
    """
    return rows.agg(*(F.percentile(c, F.lit(q)).alias(name) for name, (c, q) in wanted.items()))


def with_thresholds(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Every row beside the one row of limits."""
    return rows.crossJoin(F.broadcast(limits))


def distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, min, p25, median, p75, max, mean) of each column; mean to the millionth, exactly."""
    from tessera.functions.boxes import exact_mean

    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns))).alias("e")).select("e.*")
    stats = [F.count("v").alias("n"), F.min("v").alias("min"), *(F.percentile("v", F.lit(q)).alias(a) for a, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))), F.max("v").alias("max"), exact_mean(F.col("v")).alias("mean")]
    return long.groupBy("feature").agg(*stats)
