"""Prompt rows: one per lesion and group, ambiguous ones apart; one drawn per image; hints that mislead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import sampling

FEATURE_GROUPS = ["size", "horizontal", "vertical", "region", "size_region", "shape", "size_shape_region"]
UNIFORM = "size_shape_region"


def clue_table(spark) -> DataFrame:
    """(prompt_group, and which clues it holds); intensity and texture never are."""
    kinds = ("size", "horizontal", "vertical", "shape", "intensity", "texture")
    return spark.createDataFrame([(g, *(k in clues for k in kinds)) for g, clues in V.CLUES.items()], "prompt_group string, " + ", ".join(f"contains_{k}_clue boolean" for k in kinds))


def lesion_prompts(rows: DataFrame, groups: list[str]) -> DataFrame:
    """rows x groups with the prompt text, and n_same: how many lesions of the image it describes.

    The prompts of an image are listed per group beside each of its rows before these are multiplied, so that what is
    sorted is lesions by image, not prompts. An image's lists are as long as it has lesions.
    """
    words = [F.col(c) for c in ("size", "horizontal", "vertical", "region", "shape")]
    image = Win.partitionBy("image")
    told = rows.withColumns({f"_p_{g}": V.prompt(g, *words) for g in groups})
    listed = told.withColumns({"_all": F.count("*").over(image)} | {f"_l_{g}": F.collect_list(f"_p_{g}").over(image) for g in groups})

    def same(g):  # lists leave nulls out
        text, others = F.col(f"_p_{g}"), F.size(f"_l_{g}")
        return F.when(text.isNull(), F.col("_all") - others).otherwise(others - F.size(F.array_remove(f"_l_{g}", text))).cast("long")

    texts = F.array(*(F.struct(F.lit(g).alias("prompt_group"), F.col(f"_p_{g}").alias("prompt"), same(g).alias("n_same")) for g in groups))
    return listed.select(*rows.columns, texts.alias("_e")).select(*rows.columns, F.explode("_e").alias("p")).select(*rows.columns, "p.*")


def unambiguous(prompts: DataFrame) -> DataFrame:
    return prompts.where("n_same = 1")


def ambiguous(prompts: DataFrame) -> DataFrame:
    return prompts.where("n_same > 1")


def baseline_prompts(images: DataFrame, rows: DataFrame, label: str = "lesion") -> DataFrame:
    """One row per image with all its boxes; images without lesions have the end mark alone."""
    found = rows.groupBy("image").agg(F.count("*").alias("n_lesions"), F.array_sort(F.collect_list(F.struct("ord", "loc"))).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["loc"], F.lit(" " + label))), " ; "), F.lit("<eos>"))
    return images.join(found, "image", "left").select("image", "name", "split", F.lit("baseline").alias("prompt_group"), F.lit(V.PROMPTS["baseline"].format(cls=V.CLS)).alias("prompt"), F.coalesce(text, F.lit("<eos>")).alias("suffix"), F.coalesce("n_lesions", F.lit(0)).alias("n_lesions"))


def all_groups(images: DataFrame, rows: DataFrame, label: str = "lesion") -> DataFrame:
    """(split, image, prompt_group, prompt, suffix) of every group, with its clue flags."""
    base = baseline_prompts(images, rows, label).select("split", "name", "prompt_group", "prompt", "suffix")
    feature = unambiguous(lesion_prompts(rows, FEATURE_GROUPS)).select("split", "name", "prompt_group", "prompt", F.concat("loc", F.lit(f" {label}<eos>")).alias("suffix"))
    return base.unionByName(feature).join(F.broadcast(clue_table(rows.sparkSession)), "prompt_group")


def mixed(prompts: DataFrame, seed: int = 42) -> DataFrame:
    """One prompt per image: a group uniformly, then a row in it, by hashes of (seed, split, image)."""
    key = F.concat_ws(":", F.lit(seed), "split", "name")
    first = F.sha1(F.concat_ws(":", key, F.lit("group"), "prompt_group"))
    second = F.sha1(F.concat_ws(":", key, F.lit("row"), "suffix", "prompt"))
    pick = F.min(F.struct(first.alias("a"), second.alias("b"), F.struct("prompt_group", "prompt", "suffix").alias("row")))
    return prompts.where(F.col("prompt_group") != UNIFORM).groupBy("split", "name").agg(pick.alias("pick")).select("split", "name", "pick.row.*")


def mismatched(rows: DataFrame, key: str = "lesion_id", parts: int = 16) -> DataFrame:
    """Each row with the prompt of another one whose region and size both differ; else whose region differs.

    A row's candidates depend on its (size, region) cell alone, so no pairs are formed: the number of rows in every
    cell (and part of it, by hash) is a small table, a hash picks a place in the complement, and one equi-join on (cell,
    part, rank) fetches the row there. The numbers are the greatest ranks, so that rows are ranked from one shuffle.
    """
    part = V.hashed_choice(F.col(key), parts, "part:")
    ranked = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Win.partitionBy("size", "region", "part").orderBy(key)).cast("long"))
    counted = ranked.groupBy("size", "region", "part").agg(F.max("rank").alias("n"))
    every = counted.agg(F.collect_list(F.struct(F.col("size").alias("o_size"), F.col("region").alias("o_region"), F.col("part").alias("o_part"), "n")).alias("all"))
    cells = every.select("all", F.explode(F.array_distinct(F.transform("all", lambda o: F.struct(o["o_size"].alias("size"), o["o_region"].alias("region"))))).alias("c"))
    pairs = cells.select("c.*", F.inline("all")).where(F.col("region") != F.col("o_region"))  # at most 27 cells and 27 * parts entries
    strict = F.col("size") != F.col("o_size")
    pairs = pairs.withColumn("has", F.max(strict.cast("int")).over(Win.partitionBy("size", "region"))).where(strict | (F.col("has") == 0))
    along = Win.partitionBy("size", "region").orderBy("o_size", "o_region", "o_part")
    options = pairs.withColumn("_hi", F.sum("n").over(along)).withColumn("_lo", F.col("_hi") - F.col("n")).select("size", "region", "_lo", "_hi", "o_size", "o_region", "o_part")
    draw = F.conv(F.substring(F.sha1(F.concat(F.lit("hint:"), F.col(key))), 1, 8), 16, 10).cast("long") % F.col("_total")
    hit = sampling.in_interval(ranked.drop("part", "rank"), options, ["size", "region"], draw).withColumn("o_rank", F.col("_v") - F.col("_lo") + 1)
    target = ranked.select(F.col("size").alias("t_size"), F.col("region").alias("t_region"), F.col("part").alias("t_part"), F.col("rank").alias("t_rank"), F.col(key).alias("hint_from"))
    on = (F.col("o_size") == F.col("t_size")) & (F.col("o_region") == F.col("t_region")) & (F.col("o_part") == F.col("t_part")) & (F.col("o_rank") == F.col("t_rank"))
    return hit.join(target, on).select(*rows.columns, "hint_from", F.col("t_size").alias("hint_size"), F.col("t_region").alias("hint_region"))


REGIONS = [f"{v}-{h}" for v in ("upper", "middle", "lower") for h in ("left", "center", "right")]


def variants(rows: DataFrame) -> DataFrame:
    """Ten prompts per row, from no hint to all wrong, and the sweep over the nine regions."""
    size, shape, region = F.col("size"), F.col("shape"), F.col("region")
    wrong_size = F.when(size == "small", "large").when(size == "large", "small").otherwise("small")
    wrong_shape = F.when(shape != "tall", "tall").otherwise("wide")
    at = lambda r: (REGIONS.index(r) // 3, REGIONS.index(r) % 3)
    far = {r: max(REGIONS, key=lambda o: abs(at(o)[0] - at(r)[0]) + abs(at(o)[1] - at(r)[1])) for r in REGIONS}  # the first of the farthest
    wrong_region = V.worded(region, far)
    none = F.lit("")
    full = lambda s, sh, r: V.prompt("size_shape_region", s, none, none, r, sh)
    listed = [
        ("no hint", V.prompt("baseline", size, none, none, region, shape)),
        ("size only", V.prompt("size", size, none, none, region, shape)),
        ("shape only", V.prompt("shape", size, none, none, region, shape)),
        ("region only", V.prompt("region", size, none, none, region, shape)),
        ("size + region", V.prompt("size_region", size, none, none, region, shape)),
        ("all three true", full(size, shape, region)),
        ("wrong size", full(wrong_size, shape, region)),
        ("wrong shape", full(size, wrong_shape, region)),
        ("wrong region", full(size, shape, wrong_region)),
        ("all three wrong", full(wrong_size, wrong_shape, wrong_region)),
        *((f"sweep {r}", full(size, shape, F.lit(r))) for r in REGIONS),
    ]
    every = F.array(*(F.struct(F.lit(n).alias("variant"), t.alias("prompt")) for n, t in listed))
    return rows.withColumn("v", F.explode(every)).select(*rows.columns, "v.variant", "v.prompt")
