"""Readers and writers of records, configurations and reports. Schemas are given, never inferred over the data."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = "images array<struct<id: long, file_name: string, width: int, height: int>>, annotations array<struct<id: long, image_id: long, bbox: array<double>, category_id: int>>"
TRAINING_ROW = "image string, prefix string, suffix string"
CAPTION_ROW = TRAINING_ROW + ", sample_id string, patient string, labels struct<shape: string, orientation: string, outline: string, intensity: string, variation: string>, dynamic_caption boolean"
PREDICTION = "row int, image string, condition string, prompt string, gt string, pred string"
CAPTION_PREDICTION = "row int, sample_id string, patient string, prompt_type string, prompt string, pred string, labels struct<shape: string, orientation: string, outline: string, intensity: string, variation: string>"


def read_coco(spark: SparkSession, path: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of one annotation document, with corners and an ordinal by annotation id."""
    document = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = document.select(F.inline("images")).select(F.lit(split).alias("split"), F.col("id").alias("image_id"), F.col("file_name").alias("name"), F.col("width").alias("w"), F.col("height").alias("h"))
    found = document.select(F.inline("annotations")).select(F.col("id").alias("ann_id"), "image_id", "category_id", "bbox")
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    return images, found.select("ann_id", "image_id", "category_id", x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def write_coco(images: DataFrame, annotations: DataFrame, path: str, images_a_document: int = 16_384) -> None:
    """Annotation documents by split, as split=/part=/ folders with one document each, of a bounded range of image ids:
    images (split, image_id, name, w, h), annotations (split, image_id, ann_id, category_id, x, y, width, height)."""
    part = F.floor(F.col("image_id") / images_a_document).alias("part")
    of = lambda rows, name, *fields: rows.groupBy("split", part).agg(F.collect_list(F.struct(*fields)).alias(name))
    listed = of(images, "images", F.col("image_id").alias("id"), F.col("name").alias("file_name"), F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"))
    boxed = of(annotations, "annotations", F.col("ann_id").alias("id"), "image_id", F.array("x", "y", "width", "height").alias("bbox"), "category_id")
    none = lambda name: F.coalesce(name, F.array()).alias(name)
    whole = listed.join(boxed, ["split", "part"], "full_outer").select("split", "part", none("images"), none("annotations"))
    write_lines(whole, path, ["split", "part"])


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; path may be a glob over shards. Adds the file, so that a later shard can win."""
    return spark.read.schema(schema).json(path).withColumn("file", F.input_file_name())


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object as a one-row table, fit to be broadcast."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """The groups of every match of a pattern in text reports, one row a match."""
    text = spark.read.text(path, wholetext=True)
    groups = [F.regexp_extract_all("value", F.lit(pattern), F.lit(i + 1)) for i in range(len(names))]
    return text.select(F.explode(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, names, strict=True)))).alias("m")).select("m.*")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, name, length) of a folder's files; their contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def write_lines(rows: DataFrame, path: str, by: list[str] | None = None, compression: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path, compression=compression)


def write_datasets(rows: DataFrame, path: str) -> DataFrame:
    """Training rows (prompt_group, split, image, prefix, suffix) as prompt_group=/split=/ folders; those without a
    suffix are left out. Returns how many were written and skipped."""
    full = F.coalesce(F.length("suffix"), F.lit(0)) > 0
    write_lines(rows.where(full).select("prompt_group", "split", "image", "prefix", "suffix"), path, ["prompt_group", "split"])
    return rows.groupBy("prompt_group", "split").agg(F.count_if(full).alias("written"), F.count_if(~full).alias("skipped"))


def write_features(rows: DataFrame, path: str, columns: list[str], digits: int | None = None) -> None:
    """A fixed list of columns as CSV; digits: real numbers to so many significant ones."""
    kinds = dict(rows.dtypes)
    shown = [F.format_string(f"%.{digits}g", c).alias(c) if digits and kinds[c] == "double" else F.col(c) for c in columns]
    rows.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def write_config(row: DataFrame, path: str) -> None:
    """A one-row table as one JSON object."""
    row.coalesce(1).write.mode("overwrite").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Predictions or metrics of one step, added to those before."""
    rows.write.mode("append").json(path)


def unanswered(rows: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that a run resumed has still to answer."""
    return rows.join(answers.select(*keys).distinct(), keys, "left_anti")


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): every row as a line of a markdown table; nulls are empty cells. heading() gives the two lines before them."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def heading(columns: list[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"


def settings(text: str, **given) -> dict:
    """A configuration from YAML (of which JSON is a part), without a YAML library from JSON; what is given and not None wins."""
    try:
        from yaml import safe_load
    except ImportError:
        safe_load = json.loads
    return (safe_load(text) or {}) | {k: v for k, v in given.items() if v is not None}


def render_report(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as text: one JSON object a line. More than `limit` rows are an error; write_lines takes any number."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows: write them with write_lines instead")
    return "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in found)


def negatives(images: DataFrame, annotations: DataFrame, on: str, *by: str) -> DataFrame:
    """How many images there are and how many have no annotation, by the given columns."""
    known = annotations.select(on).distinct().withColumn("_known", F.lit(True))
    return images.join(known, on, "left").groupBy(*by).agg(F.count("*").alias("images"), F.count_if(F.col("_known").isNull()).alias("negatives"))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share; a temporary one in local sessions."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
