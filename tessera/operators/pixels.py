"""Statistics of grey images in long form (id, x, y, g whole number, fg mask), and connected components.

Sums are of whole numbers, so they are exact and don't depend on row order; one division comes last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F


def moments(values: DataFrame, *keys: str, value: str = "g") -> DataFrame:
    v = F.col(value)
    return values.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(_power(v, k)).alias(f"s{k}") for k in (1, 2, 3, 4)), F.min(v).alias("min"), F.max(v).alias("max"))


def _power(v, k):
    out = v
    for _ in range(k - 1):
        out = out * v
    return out


def _variance():
    """Population variance from exact sums."""
    return (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("n") * F.col("n"))


def intensity(pixels: DataFrame) -> DataFrame:
    """Mask statistics against the rest of the image; NaN where there is no surround or its mean is 0."""
    inside = pixels.where("fg").groupBy("id").agg(F.count("*").alias("n"), F.sum("g").alias("s1"), F.sum(F.col("g") * F.col("g")).alias("s2"), F.min("g").alias("min"), F.max("g").alias("max"), *(F.percentile("g", F.lit(q)).alias(a) for a, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))))
    around = pixels.where("not fg").groupBy("id").agg(F.count("*").alias("ring_n"), F.sum("g").alias("ring_s"))
    mean, ring = F.col("s1") / F.col("n"), F.try_divide(F.col("ring_s"), F.col("ring_n"))
    nan = F.lit(float("nan"))
    ok = F.col("ring_n").isNotNull() & (F.col("ring_s") != 0)
    return inside.join(around, "id", "left").select(
        "id", "n", mean.alias("mean"), F.sqrt(_variance()).alias("std"), "min", "max", "q25", "median", "q75",
        F.when(F.col("ring_n").isNotNull(), mean - ring).otherwise(nan).alias("difference"),
        F.when(ok, F.try_divide(mean, ring)).otherwise(nan).alias("ratio"),
    )


def texture(pixels: DataFrame) -> DataFrame:
    """(id, n, distinct, entropy in millionths of a bit): Shannon entropy of the grey histogram."""
    counts = pixels.groupBy("id", "g").agg(F.count("*").alias("c"))
    total = counts.groupBy("id").agg(F.sum("c").alias("n"), F.count("*").alias("levels"), F.array_sort(F.collect_list("c")).alias("cs"))  # 256 grey levels at most
    term = lambda c: -(c / F.col("n")) * F.log2(c / F.col("n"))
    bits = F.aggregate("cs", F.lit(0.0), lambda a, c: a + term(c))
    return total.select("id", "n", "levels", F.floor(bits * 1e6 + 0.5).cast("long").alias("entropy_millionths"))


def gradients(pixels: DataFrame) -> DataFrame:
    """(id, x, y, gx, gy): 3 x 3 Sobel responses, edges repeated, by lag and lead along rows and then columns."""
    along = Win.partitionBy("id", "y").orderBy("x")
    row = pixels.select("id", "x", "y", "g", F.coalesce(F.lag("g").over(along), F.col("g")).alias("l"), F.coalesce(F.lead("g").over(along), F.col("g")).alias("r"))
    row = row.select("id", "x", "y", (F.col("r") - F.col("l")).alias("d"), (F.col("l") + 2 * F.col("g") + F.col("r")).alias("s"))
    down = Win.partitionBy("id", "x").orderBy("y")
    near = lambda f, c: F.coalesce(f(c).over(down), F.col(c))
    return row.select("id", "x", "y", (near(F.lag, "d") + 2 * F.col("d") + near(F.lead, "d")).alias("gx"), (near(F.lead, "s") - near(F.lag, "s")).alias("gy"))


def gradient_stats(pixels: DataFrame) -> DataFrame:
    """(id, n, energy, strongest): squared gradient magnitudes, exactly."""
    square = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")
    return gradients(pixels).groupBy("id").agg(F.count("*").alias("n"), F.sum(square).alias("energy"), F.max(square).alias("strongest"))


def shape_moments(pixels: DataFrame) -> DataFrame:
    """Area, centroid, box, extent and the covariance ellipse of each mask (a pixel adds 1/12 to both variances)."""
    x, y = F.col("x"), F.col("y")
    m = pixels.where("fg").groupBy("id").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) + 1).alias("x1"), (F.max(y) + 1).alias("y1"))
    nn = F.col("n") * F.col("n")
    cov = lambda ab, a, b: (F.col("n") * F.col(ab) - F.col(a) * F.col(b)) / nn
    m = m.withColumn("cxx", cov("sxx", "sx", "sx") + 1 / 12).withColumn("cyy", cov("syy", "sy", "sy") + 1 / 12).withColumn("cxy", cov("sxy", "sx", "sy"))
    half, gap = (F.col("cxx") + F.col("cyy")) / 2, F.sqrt((F.col("cxx") - F.col("cyy")) * (F.col("cxx") - F.col("cyy")) / 4 + F.col("cxy") * F.col("cxy"))
    m = m.withColumn("major", half + gap).withColumn("minor", half - gap)
    return m.select(
        "id", F.col("n").alias("area"), (F.col("sx") / F.col("n")).alias("cx"), (F.col("sy") / F.col("n")).alias("cy"), "x0", "y0", "x1", "y1",
        (F.col("n") / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("extent"),
        "cxx", "cyy", "cxy", "major", "minor",
        F.sqrt(F.col("major") / F.col("minor")).alias("axis_ratio"),
        F.sqrt(1 - F.col("minor") / F.col("major")).alias("eccentricity"),
        F.degrees(0.5 * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy"))).alias("angle"),
    )


def extra_statistics(pixels: DataFrame) -> DataFrame:
    """(id, n, skew, kurtosis (excess), p10, p90, cv, bright): of the mask's grey values, from exact central sums."""
    inside = pixels.where("fg")
    per = moments(inside, "id")
    joined = inside.join(per, "id")
    # n * g - s1 is n times the deviation, a whole number
    d = F.col("n") * F.col("g") - F.col("s1")
    decimal = lambda c: c.cast("decimal(38,0)")
    sums = joined.groupBy("id", "n", "s1", "s2").agg(F.sum(decimal(d * d * d)).alias("d3"), F.sum(decimal(d * d) * decimal(d * d)).alias("d4"), F.percentile("g", F.lit(0.1)).alias("p10"), F.percentile("g", F.lit(0.9)).alias("p90"), F.sum(F.when((d > 0) & (d * d > F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")), 1).otherwise(0)).alias("above"))
    n = F.col("n").cast("double")
    std = F.sqrt(_variance())
    return sums.select(
        "id", "n",
        (F.col("d3").cast("double") / (n * n * n * n) / (std * std * std + 1e-8)).alias("skew"),
        (F.col("d4").cast("double") / (n * n * n * n * n) / (std * std * std * std + 1e-8) - 3.0).alias("kurtosis"),
        "p10", "p90", (std / (F.col("s1") / F.col("n") + 1e-8)).alias("cv"), (F.col("above") / F.col("n")).alias("bright"),
    )


def solidity(pixels: DataFrame) -> DataFrame:
    """(id, area, hull): mask pixels, and pixels whose centre lies in the convex hull of the mask's pixel centres.

    A pixel is outside if some pair of mask pixels has it strictly on one side and no mask pixel there; within an image
    that is a scan of its few extreme pixels per row, done by image in numpy.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fg = group[group["fg"]]
        points = sorted(set(zip(fg["x"].tolist(), fg["y"].tolist(), strict=True)))
        if not points:
            return pd.DataFrame({"id": [], "area": [], "hull": []}).astype("int64")

        def chain(seq):
            out = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        hull = chain(points)[:-1] + chain(points[::-1])[:-1] or points
        xy = group[["x", "y"]].to_numpy()
        inside = np.ones(len(xy), dtype=bool)
        if len(hull) < 3:
            (ax, ay), (bx, by) = hull[0], hull[-1]
            on = (bx - ax) * (xy[:, 1] - ay) == (by - ay) * (xy[:, 0] - ax)
            inside = on & (xy[:, 0] >= min(ax, bx)) & (xy[:, 0] <= max(ax, bx)) & (xy[:, 1] >= min(ay, by)) & (xy[:, 1] <= max(ay, by))
        else:
            for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
                inside &= (bx - ax) * (xy[:, 1] - ay) - (by - ay) * (xy[:, 0] - ax) >= 0
        return pd.DataFrame({"id": [group["id"].iloc[0]], "area": [len(points)], "hull": [int(inside.sum())]})

    return pixels.groupBy("id").applyInPandas(run, "id long, area long, hull long")


def components(pixels: DataFrame) -> DataFrame:
    """(id, x, y, blob): 8-connected components of each mask; a blob is named by its least y * 2^20 + x."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fg = group[group["fg"]]
        xs, ys = fg["x"].to_numpy(), fg["y"].to_numpy()
        if not len(xs):
            return pd.DataFrame({"id": [], "x": [], "y": [], "blob": []}).astype("int64")
        grid = np.full((ys.max() + 3, xs.max() + 3), np.iinfo(np.int64).max)
        own = ys.astype(np.int64) * (1 << 20) + xs
        grid[ys + 1, xs + 1] = own
        while True:
            best = grid[ys + 1, xs + 1]
            for dy in (0, 1, 2):
                for dx in (0, 1, 2):
                    best = np.minimum(best, grid[ys + dy, xs + dx])
            if (best == grid[ys + 1, xs + 1]).all():
                break
            grid[ys + 1, xs + 1] = best
        return pd.DataFrame({"id": fg["id"].to_numpy(), "x": xs, "y": ys, "blob": grid[ys + 1, xs + 1]})

    return pixels.groupBy("id").applyInPandas(run, "id long, x long, y long, blob long")


def reliability(pairs: DataFrame) -> DataFrame:
    """pairs (feature, a, b whole numbers): Pearson correlation and a verdict; 0 where a side is constant."""
    a, b = (F.col(c).cast("decimal(38,0)") for c in ("a", "b"))
    s = pairs.groupBy("feature").agg(F.count("*").cast("decimal(38,0)").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"))
    part = lambda p, q, r: (F.col("n").cast("double") * F.col(p).cast("double") - F.col(q).cast("double") * F.col(r).cast("double"))
    va, vb, cov = part("saa", "sa", "sa"), part("sbb", "sb", "sb"), part("sab", "sa", "sb")
    r = F.when((va > 0) & (vb > 0), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb))).otherwise(0.0)
    return s.select("feature", F.col("n").cast("long").alias("n"), r.alias("r")).withColumn("verdict", F.when(F.col("r") >= 0.9, "RELIABLE").when(F.col("r") >= 0.7, "use with caution").otherwise("NOT reliable"))
