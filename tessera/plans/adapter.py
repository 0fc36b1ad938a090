"""Images, lesions, captions and pixels derived from the star-schema tables, deterministically.

An image is an order, a patient its customer, a lesion a line item; patients are dealt to splits 55 : 7 : 17.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tessera.functions import boxes as B
from tessera.operators.thresholds import fit_thresholds, with_thresholds

LEVELS = ("low", "mid", "high")
AXES = ("vertical", "diagonal", "horizontal", "none")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("o_custkey") % 79
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image"),
        F.concat_ws("_", "o_custkey", F.concat("o_orderkey", F.lit(".png"))).alias("name"),
        F.col("o_custkey").cast("string").alias("patient"),
        F.when(part < 55, "train").when(part < 62, "valid").otherwise("test").alias("split"),
        F.lit(512.0).alias("w"),
        F.element_at(F.array(F.lit(512.0), F.lit(555.0), F.lit(588.0)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("h"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, ord, pk, sk, ln, q, x, y, width, height): boxes as xywh, numbered within their image."""
    order = Win.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pk, sk, ln, q = (F.col(c) for c in ("pk", "sk", "ln", "q"))
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        .withColumn("ord", F.row_number().over(order))
        .select(F.col("l_orderkey").alias("image"), "ord", F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").cast("long").alias("ln"), F.col("l_quantity").cast("long").alias("q"))
        .select(
            "*",
            ((pk * 37 + ln * 91) % 380).cast("double").alias("x"),
            ((sk * 53 + pk * 17 + ln * 29) % 380).cast("double").alias("y"),
            (6 + (q * 7 + pk) % 110).cast("double").alias("width"),
            (6 + (q * 3 + ln * 13 + pk * 5) % 110).cast("double").alias("height"),
        )
    )


def lesions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lesion with its image, box and box features."""
    joined = annotations(spark, sf_dir).join(images(spark, sf_dir), "image")
    boxed = joined.withColumn("box", B.corners(F.col("x"), F.col("y"), F.col("width"), F.col("height"))).select("*", "box.*")
    named = boxed.withColumn("lesion_id", F.concat("name", F.when(F.col("ord") < 10, "_box0").otherwise("_box"), F.col("ord").cast("string")))
    return named.select("*", *(c.alias(n) for n, c in B.box_features(*B.box().values(), F.col("w"), F.col("h")).items())).drop("x", "y", "width", "height", "box")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lesions with bands fitted on the training split, and their coordinate tokens."""
    found = lesions(spark, sf_dir)
    limits = fit_thresholds(found.where("split = 'train'"), {"small_max": ("bbox_area_ratio", 0.33), "medium_max": ("bbox_area_ratio", 0.67)})
    return describe(with_thresholds(found, limits))


def describe(found: DataFrame) -> DataFrame:
    return found.select(
        "*",
        B.size_band(F.col("bbox_area_ratio"), F.col("small_max"), F.col("medium_max")).alias("size"),
        B.shape(F.col("aspect_ratio")).alias("shape"),
        B.horizontal(F.col("center_x_norm")).alias("horizontal"),
        B.vertical(F.col("center_y_norm")).alias("vertical"),
        B.region(F.col("center_x_norm"), F.col("center_y_norm")).alias("region"),
        _loc(),
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lesions with their coordinate tokens alone: all that predictions() needs, without a pass that fits bands."""
    return lesions(spark, sf_dir).select("*", _loc())


def _loc():
    return B.tokens(*B.box().values(), F.col("w"), F.col("h")).alias("loc")


def _shifted(dx, dy, keep) -> list:
    x0, x1 = F.greatest(F.lit(0.0), F.col("x0") + dx), F.least(F.col("w"), F.col("x1") + dx)
    y0, y1 = F.greatest(F.lit(0.0), F.col("y0") + dy), F.least(F.col("h"), F.col("y1") + dy)
    return F.when(keep, B.tokens(x0, y0, x1, y1, F.col("w"), F.col("h")))


def predictions(rows: DataFrame) -> DataFrame:
    """rows x (matched, baseline, oracle): the answers of predictors that need no model, as text."""
    pk, sk = F.col("pk"), F.col("sk")
    label = F.lit(" lesion")
    one = _shifted(((pk % 7) - 3) * 4.0, F.lit(0.0), sk % 13 != 0)
    two = F.when(pk % 11 == 0, F.concat(one, label, F.lit(" ; "), F.col("loc"), label)).otherwise(F.concat(one, label))
    other = F.concat(_shifted(((pk % 9) - 4) * 5.0, ((pk % 5) - 2) * 6.0, sk % 7 != 0), label)
    answers = F.array(
        F.struct(F.lit("matched").alias("condition"), F.coalesce(two, F.lit("none")).alias("pred")),
        F.struct(F.lit("baseline").alias("condition"), F.coalesce(other, F.lit("none")).alias("pred")),
        F.struct(F.lit("oracle").alias("condition"), F.concat("loc", label).alias("pred")),
    )
    return rows.withColumn("answer", F.explode(answers)).select("*", "answer.*").drop("answer")


def _level(value, names=LEVELS):
    return F.element_at(F.array(*(F.lit(n) for n in names)), (value % len(names) + 1).cast("int"))


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lesion_id, patient, split, labels of the five facts, pk, sk, q)."""
    pk, sk, ln, q = (F.col(c) for c in ("pk", "sk", "ln", "q"))
    return lesions(spark, sf_dir).select(
        "lesion_id", "patient", "split", "pk", "sk", "q",
        _level(pk).alias("shape"), _level(sk, AXES).alias("orientation"), _level(pk + sk).alias("outline"), _level(ln).alias("intensity"), _level(q).alias("variation"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x, y, g, fg): each vector as an 8 x 8 grey image in long form; fg marks the mask."""
    long = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding"))
    grey = F.floor(F.col("col").cast("double") * 400 + 128).cast("long")
    return long.select("id", "label", (F.col("pos") % 8).cast("long").alias("x"), F.floor(F.col("pos") / 8).cast("long").alias("y"), grey.alias("g")).withColumn("fg", F.col("g") > 128)


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, w, h, px, mask, x0, y0, x1, y1): each vector as an 8 x 8 grey image in one binary column, with its mask and a box."""
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 400 + 128).cast("int")).alias("g")).where("size(g) = 64")
    packed = lambda of: F.unhex(F.array_join(F.transform("g", lambda g: F.lpad(F.hex(of(g)), 2, "0")), ""))
    i, eight = F.col("id"), F.lit(8).cast("long")
    x0, y0 = i % 3, i % 2
    return found.select("id", eight.alias("w"), eight.alias("h"), packed(lambda g: F.least(F.greatest(g, F.lit(0)), F.lit(255))).alias("px"), packed(lambda g: (g > 128).cast("int")).alias("mask"), x0.alias("x0"), y0.alias("y0"), (x0 + 3 + i % 4).alias("x1"), (y0 + 4 + i % 3).alias("y1"))
