"""Joins of images, annotations and detected blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tessera.functions import boxes as B


def images_with_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image with its number of annotations and their first and last ordinal; 0 and nulls without any."""
    per_image = annotations.groupBy("image").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    return images.join(per_image, "image", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def orphans(annotations: DataFrame, images: DataFrame) -> DataFrame:
    return annotations.join(images.select("image"), "image", "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): what only one of two name lists holds."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only")
    return a.join(b, key, "full_outer").select(key, side.alias("side")).where("side is not null")


def reconcile_files(pictures: DataFrame, masks: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, kind): pictures, masks and listed names held against each other; a name may have several kinds. One shuffle."""
    tagged = lambda rows, n: rows.select(key, *(F.lit(i == n).alias(c) for i, c in enumerate("pml")))
    every = tagged(pictures, 0).unionByName(tagged(masks, 1)).unionByName(tagged(listed, 2))
    p, m, named = (F.col(c) for c in "pml")
    kinds = {"png_without_mask": p & ~m, "mask_without_png": m & ~p, "coco_entry_without_file": named & ~(p & m), "png_not_in_any_coco_split": p & ~named}
    found = F.filter(F.array(*(F.when(when, F.lit(kind)) for kind, when in kinds.items())), lambda k: k.isNotNull())
    return every.groupBy(key).agg(*(F.bool_or(c).alias(c) for c in "pml")).select(key, F.explode(found).alias("kind"))


def best_blob(annotations: DataFrame, blobs: DataFrame, flag_below: float = 0.9) -> DataFrame:
    """Each annotation with the blob of its image of greatest overlap (lesser blob number on ties) and a status:
    no_overlap, already_claimed (by a lesser annotation), weak_overlap or ok. Candidates never leave their image."""
    other = blobs.select("image", F.col("blob"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    pairs = annotations.join(other, "image", "left").withColumn("overlap", B.iou(B.box(), B.box("b_")))
    best = F.max(F.struct("overlap", (-F.col("blob")).alias("minus"))).alias("best")
    chosen = pairs.groupBy("image", "ord").agg(best).select("image", "ord", F.col("best.overlap").alias("overlap"), F.when(F.col("best.overlap") > 0, -F.col("best.minus")).alias("blob"))
    claim = F.row_number().over(Win.partitionBy("image", "blob").orderBy("ord"))
    status = F.when(F.col("blob").isNull(), "no_overlap").when(F.col("claim") > 1, "already_claimed").when(F.col("overlap") < flag_below, "weak_overlap").otherwise("ok")
    return chosen.withColumn("claim", claim).select("image", "ord", "blob", B.millionths(F.col("overlap")).alias("overlap_millionths"), status.alias("status"))


def exact_box(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equi-join on image and the four corners as whole numbers."""
    corners = [F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]
    a = left.select("image", F.col("ord").alias("left_ord"), *corners)
    b = right.select("image", F.col("ord").alias("right_ord"), *corners)
    return a.join(b, ["image", "x0", "y0", "x1", "y1"])


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the last in order."""
    return rows.withColumn("_n", F.row_number().over(Win.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
