"""Augmentation that keeps labels true: geometry as columns, draws by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import boxes as B
from tessera.operators.sampling import hashed


def uniform(key: str, salt: str) -> Column:
    """0 to 1, in 2^-32 steps."""
    return hashed(F.col(key), salt=salt) / float(1 << 32)


def moved_boxes(rows: DataFrame, key: str, scale: float = 0.1, shift: float = 0.05, keep: float = 0.8, least_side: float = 4.0) -> DataFrame:
    """Each box scaled about the image centre and shifted. kept: enough of it stays inside, and its sides are long
    enough. n_x0 .. n_y1 is the new box, cut to the image, and loc its tokens: labels are to be taken from those."""
    s = 1 - scale + 2 * scale * uniform(key, "scale")
    ends = {}
    for axis, size in (("x", "w"), ("y", "h")):
        by = (2 * uniform(key, f"shift-{axis}") - 1) * shift * F.col(size)
        for end in ("0", "1"):
            ends[axis + end] = (F.col(axis + end) - F.col(size) / 2) * s + F.col(size) / 2 + by
    moved = rows.select("*", *(c.alias(f"m_{n}") for n, c in ends.items()))
    for axis, size in (("x", "w"), ("y", "h")):
        for end in ("0", "1"):
            moved = moved.withColumn(f"n_{axis}{end}", F.least(F.greatest(F.col(f"m_{axis}{end}"), F.lit(0.0)), F.col(size)))
    wide, high = F.col("n_x1") - F.col("n_x0"), F.col("n_y1") - F.col("n_y0")
    whole = (F.col("m_x1") - F.col("m_x0")) * (F.col("m_y1") - F.col("m_y0"))
    kept = (wide >= least_side) & (high >= least_side) & (wide * high >= keep * whole)
    return moved.withColumn("kept", kept).withColumn("loc", B.tokens(*B.box("n_").values(), F.col("w"), F.col("h"))).drop("m_x0", "m_y0", "m_x1", "m_y1")


def flipped(pixels: DataFrame, side: int) -> DataFrame:
    """Square images mirrored and turned by quarters, one of eight ways by a hash of the id; way tells which."""
    way = (hashed(F.col("id"), salt="flip") % 8).cast("int")
    x = F.when(F.col("way") >= 4, side - 1 - F.col("x")).otherwise(F.col("x"))
    turned = pixels.withColumn("way", way).withColumn("x", x)
    last = side - 1
    quarter = F.col("way") % 4
    a, b = F.col("x"), F.col("y")
    new_x = F.when(quarter == 0, a).when(quarter == 1, b).when(quarter == 2, last - a).otherwise(last - b)
    new_y = F.when(quarter == 0, b).when(quarter == 1, last - a).when(quarter == 2, last - b).otherwise(a)
    return turned.select(*[c for c in pixels.columns if c not in ("x", "y")], "way", new_x.alias("x"), new_y.alias("y"))
