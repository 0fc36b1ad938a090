"""Images through the JVM's decoder, to grey pixels in long form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of blue, green and red in grey, in 1/16384.
WEIGHTS = (1868, 9617, 4899)


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    return found.select(F.element_at(F.split("origin", "/"), -1).alias("name"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("nChannels").alias("channels"), "data")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, w, h, channels, data): data is row by row, blue first. Files that don't decode are in `unreadable`."""
    return _decoded(spark, path).where("channels > 0")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(name, error) of the files that don't decode."""
    return _decoded(spark, path).where("channels <= 0").select("name", F.lit("unreadable_image").alias("error"))


def same_channels(images: DataFrame) -> DataFrame:
    """(name, channels, identical): whether all channels of an image hold the same values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                raw = np.frombuffer(row.data, np.uint8).reshape(-1, row.channels)
                yield pd.DataFrame({"name": [row.name], "channels": [row.channels], "identical": [bool((raw == raw[:, :1]).all())]})

    return images.select("name", "channels", "data").mapInPandas(run, "name string, channels int, identical boolean")


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(name, w, h): write this once and join it, as decoding is not skipped by column pruning."""
    return read_images(spark, path).select("name", "w", "h")


def grey_pixels(images: DataFrame, how: str = "grey") -> DataFrame:
    """(name, x, y, g); how: weighted grey, or the maximum over channels (masks). Rows of a few images at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                raw = np.frombuffer(row.data, np.uint8).reshape(row.h, row.w, row.channels).astype(np.int64)[:, :, :3]
                if raw.shape[2] == 1:
                    grey = raw[:, :, 0]
                elif how == "max":
                    grey = raw.max(axis=2)
                else:
                    grey = (raw @ np.array(WEIGHTS) + 8192) >> 14
                ys, xs = np.mgrid[0 : row.h, 0 : row.w]
                yield pd.DataFrame({"name": row.name, "x": xs.ravel().astype(np.int64), "y": ys.ravel().astype(np.int64), "g": grey.ravel()})

    return images.select("name", "w", "h", "channels", "data").mapInPandas(run, "name string, x long, y long, g long")


def letterboxed(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixels moved to the centre of a square of the longer side."""
    side = F.greatest("w", "h")
    joined = pixels.join(sizes, "name")
    return joined.select("name", (F.col("x") + F.floor((side - F.col("w")) / 2)).alias("x"), (F.col("y") + F.floor((side - F.col("h")) / 2)).alias("y"), "g")


def turned(pixels: DataFrame, sizes: DataFrame, quarter_turns: int = 0, mirror: bool = False) -> DataFrame:
    """Flips and quarter turns (counter-clockwise) as coordinate swaps."""
    x, y, w, h = (F.col(c) for c in "xywh")
    if mirror:
        x = w - 1 - x
    for _ in range(quarter_turns % 4):
        x, y, w, h = y, w - 1 - x, h, w
    return pixels.join(sizes, "name").select("name", x.alias("x"), y.alias("y"), "g")
