"""Evaluation of predicted boxes against one target box per row.

Answers are rows (row key, condition, pred text, target box, image size). Means of overlaps are taken over whole
millionths, so that they don't depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tessera.functions import boxes as B
from tessera.functions import vocabulary as V


def scored(answers: DataFrame, label: str = "lesion") -> DataFrame:
    """Adds boxes (all that the answer states), first (the first of them or null) and iou (0 without one)."""
    found = answers.withColumn("boxes", B.decoded(F.col("pred"), F.col("w"), F.col("h"), label))
    found = found.withColumn("first", F.get("boxes", F.lit(0)))
    return found.withColumn("iou", B.iou(F.col("first"), B.box()))


def iou_summary(rows: DataFrame, *keys: str) -> DataFrame:
    value = F.col("iou")
    share = lambda c: F.count_if(c) / F.count("*")
    stats = [
        F.count("*").alias("n"),
        B.exact_mean(value).alias("mean_iou"),
        F.percentile(B.millionths(value), F.lit(0.5)).alias("median_iou_millionths"),
        share(value >= 0.5).alias("at_50"),
        share(value >= 0.3).alias("at_30"),
        share(value == 0).alias("missed"),
    ]
    return rows.groupBy(*keys).agg(*stats) if keys else rows.agg(*stats)


PRIOR_KEYS = (("size", "shape", "region"), ("shape", "region"), ("region",), ())


def prior_boxes(rows: DataFrame) -> DataFrame:
    """Mean box of the raw rows at each level of (size, shape, region), by grouping sets; level 3 is the finest."""
    means = [B.exact_mean(F.col(c)).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")]
    sets = [[F.col(c) for c in keys] for keys in PRIOR_KEYS]
    level = (3 - (F.grouping("size") + F.grouping("shape") + F.grouping("region"))).cast("int")
    return rows.groupingSets(sets, "size", "shape", "region").agg(level.alias("level"), F.count("*").alias("n"), *means)


def with_prior(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds the prior box of the finest level that has one, and prior_iou. The priors are at most 64 rows."""
    out = rows
    for keys in PRIOR_KEYS:
        level = len(keys)
        part = priors.where(f"level = {level}").select(*(F.col(k).alias(f"k_{k}") for k in keys), F.struct(*(F.col(f"p_{c}").alias(c) for c in ("x0", "y0", "x1", "y1"))).alias(f"prior{level}"))
        on = None
        for k in keys:
            same = F.col(k) == F.col(f"k_{k}")
            on = same if on is None else on & same
        out = out.join(F.broadcast(part), on if on is not None else F.lit(True), "left").drop(*(f"k_{k}" for k in keys))
    out = out.withColumn("prior", F.coalesce(*(F.col(f"prior{n}") for n in (3, 2, 1, 0)))).drop("prior0", "prior1", "prior2", "prior3")
    return out.withColumn("prior_iou", B.iou(F.col("prior"), B.box()))


def paired(rows: DataFrame, key: str, conditions: list[str]) -> DataFrame:
    """One row per key that has every condition, its overlap under each; of repeated answers the greatest stands."""
    wide = rows.groupBy(key).pivot("condition", conditions).agg(F.max("iou"))
    return wide.dropna(subset=conditions)


def win_rates(wide: DataFrame, a: str, b: str) -> DataFrame:
    n = F.count("*")
    return wide.agg(n.alias("n"), (F.count_if(F.col(a) > F.col(b)) / n).alias("better"), (F.count_if(F.col(a) < F.col(b)) / n).alias("worse"))


def obedience(rows: DataFrame) -> DataFrame:
    """Of the rows that state a box: does it lie as the (wrong) hint says, or as the image shows?"""
    first = {c: F.col(f"first.{c}") for c in ("x0", "y0", "x1", "y1")}
    features = B.box_features(*first.values(), F.col("w"), F.col("h"))
    region = B.region(features["center_x_norm"], features["center_y_norm"])
    size = B.size_band(features["bbox_area_ratio"], F.col("small_max"), F.col("medium_max"))
    n = F.count("*")
    share = lambda c: F.count_if(c) / n
    return (
        rows.where("first is not null")
        .select("*", region.alias("got_region"), size.alias("got_size"))
        .agg(n.alias("n"), share(F.col("got_region") == F.col("hint_region")).alias("region_as_hint"), share(F.col("got_region") == F.col("region")).alias("region_as_image"), share(F.col("got_size") == F.col("hint_size")).alias("size_as_hint"), share(F.col("got_size") == F.col("size")).alias("size_as_image"))
    )


def strata(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(stratum, value, n, means) for each key on its own, by grouping sets."""
    which = F.coalesce(*(F.when(F.grouping(k) == 0, k) for k in keys))
    return rows.groupingSets([[F.col(k)] for k in keys], *keys).agg(which.alias("stratum"), F.coalesce(*keys).alias("value"), F.count("*").alias("n"), *(B.exact_mean(F.col(v)).alias(f"mean_{v}") for v in values)).drop(*keys)


def seen_flag(rows: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Adds seen: whether the combination of keys occurs in train. Combinations are few, by vocabulary."""
    known = train.select(*keys).distinct().withColumn("known", F.lit(True))
    return rows.join(F.broadcast(known), keys, "left").withColumn("seen", F.coalesce("known", F.lit(False))).drop("known")


LEVELS = [50 + 5 * k for k in range(10)]


def average_precisions(rows: DataFrame, order: list[str], per: int = 1024) -> DataFrame:
    """(condition, boxes, level, ap): average precision at overlap levels .50 to .95, 101 points, for rows of one target each;
    boxes: of all that an answer states, or the first alone.

    All confidences are 1, so answers rank by `order` (its first column a number) and ordinal. Within a row a box counts
    if it is the first that reaches the level. Running counts go by blocks of `per` keys: totals per block are summed
    along the blocks, and each block is summed on its own, so no window holds more than a block or the list of blocks.
    A box is one row in that window, whatever the levels: it holds how many its row had reached before it and with it.
    """
    reached = lambda overlap: F.size(F.filter(F.array(*(F.lit(n) for n in LEVELS)), lambda n: overlap >= n / 100))
    overlaps = F.transform("boxes", lambda b: B.iou(b, B.box()))
    each = rows.select("condition", *order, overlaps.alias("overlaps")).withColumn("upto", F.transform("overlaps", reached))
    each = each.select("condition", *order, "upto", F.posexplode_outer("upto").alias("place", "to"))  # a row without boxes stays as a target
    before = F.when(F.col("place") > 0, F.array_max(F.slice("upto", 1, F.greatest("place", F.lit(1))))).otherwise(0)
    at = each.select("condition", *order, "place", before.alias("had"), F.greatest("to", before).alias("has"), F.floor(F.col(order[0]) / per).alias("block"))
    kinds = {"all": F.col("place").isNotNull(), "first": F.col("place") == 0}
    hits = {f"{kind}{k}": which & (F.col("had") <= k) & (F.col("has") > k) for kind, which in kinds.items() for k in range(len(LEVELS))}
    sums = hits | {f"{kind}_seen": which for kind, which in kinds.items()} | {"targets": F.coalesce(F.col("place"), F.lit(0)) == 0}
    inside = Win.partitionBy("condition", "block").orderBy(*order, F.asc_nulls_first("place")).rowsBetween(Win.unboundedPreceding, 0)
    run = at.withColumns({name: F.sum(when.cast("long")).over(inside) if name == "targets" else F.sum(F.coalesce(when, F.lit(False)).cast("long")).over(inside) for name, when in sums.items()})
    # a block's totals are its greatest sums, from the same shuffle
    along = Win.partitionBy("condition").orderBy("block").rowsBetween(Win.unboundedPreceding, -1)
    totals = run.groupBy("condition", "block").agg(*(F.max(name).alias(name) for name in sums))
    starts = totals.select("condition", "block", *(F.coalesce(F.sum(name).over(along), F.lit(0)).alias(f"{name}0") for name in sums if name != "targets"), F.sum("targets").over(Win.partitionBy("condition")).alias("all_targets"))
    met = run.where("place is not null").join(starts, ["condition", "block"])
    at_level = F.array(*(F.struct(F.lit(kind).alias("boxes"), F.lit(level).alias("level"), (F.col(f"{kind}{k}") + F.col(f"{kind}{k}0")).alias("tp"), (F.col(f"{kind}_seen") + F.col(f"{kind}_seen0")).alias("seen"), which.alias("own")) for kind, which in kinds.items() for k, level in enumerate(LEVELS)))
    run = met.select("condition", F.col("all_targets").alias("targets"), at_level.alias("_e")).select("condition", "targets", F.inline("_e")).where("own")
    points = run.groupBy("condition", "boxes", "level", F.floor(F.col("tp") * 100 / F.col("targets")).alias("recall")).agg(F.max(F.col("tp") / F.col("seen")).alias("precision"))
    # the envelope at recall r is the best precision at r or beyond; at most 101 rows a window
    beyond = Win.partitionBy("condition", "boxes", "level").orderBy("recall")
    steps = points.select("condition", "boxes", "level", "recall", F.max("precision").over(beyond.rowsBetween(0, Win.unboundedFollowing)).alias("precision"), F.coalesce(F.lag("recall").over(beyond), F.lit(-1)).alias("previous"))
    return steps.groupBy("condition", "boxes", "level").agg((F.sum(B.millionths(F.col("precision")) * (F.col("recall") - F.col("previous"))) / (101 * 1e6)).alias("ap"))


def average_precision(rows: DataFrame, order: list[str], first_only: bool = False, per: int = 1024) -> DataFrame:
    """(condition, level, ap): average_precisions of all boxes, or of the first alone."""
    return average_precisions(rows, order, per).where(F.col("boxes") == ("first" if first_only else "all")).drop("boxes")


def mean_average_precision(levels: DataFrame, *keys: str) -> DataFrame:
    at = lambda n: F.max(F.when(F.col("level") == n, F.col("ap")))
    return levels.groupBy("condition", *keys).agg(at(50).alias("map50"), at(75).alias("map75"), (F.sum(B.millionths(F.col("ap"))) / (len(LEVELS) * 1e6)).alias("map50_95"))


def best_target(rows: DataFrame, boxes: Column, targets: Column) -> DataFrame:
    """Adds best_iou: of the first box, with whichever target is nearest."""
    first = F.get(boxes, F.lit(0))
    return rows.withColumn("best_iou", F.coalesce(F.array_max(F.transform(targets, lambda t: B.iou(first, t))), F.lit(0.0)))


def read_targets(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds boxes (what the suffix states), first_loc (its first box's tokens) and known: whether the image's baseline rows
    hold these. Both sides go by image, as they come, before rows are multiplied by prompts."""
    listed = F.array_distinct(F.regexp_extract_all("suffix", F.lit(r"((?:<loc\d{4}>){4})"), F.lit(1)))
    held = baseline.groupBy("image").agg(F.flatten(F.collect_list(listed)).alias("_held"))
    found = rows.join(held, "image", "left").withColumn("first_loc", F.regexp_extract("suffix", r"((?:<loc\d{4}>){4})", 1))
    known = F.coalesce(F.array_contains("_held", F.col("first_loc")), F.lit(False))
    return found.withColumns({"boxes": B.decoded(F.col("suffix"), F.col("w"), F.col("h")), "known": known}).drop("_held")


CLAIM_KINDS = ("size", "h", "v", "shape", "region")


def _read_claims(prompts: DataFrame) -> DataFrame:
    """Adds, of each kind, _said_ (null where the prompt says nothing) and _shown_ (by the first of boxes, what the suffix states)."""
    boxed = prompts if "boxes" in prompts.columns else prompts.withColumn("boxes", B.decoded(F.col("suffix"), F.col("w"), F.col("h")))
    boxed = boxed.withColumn("b", F.get("boxes", F.lit(0)))
    features = B.box_features(*(F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1")), F.col("w"), F.col("h"))
    derived = {
        "size": B.size_band(features["bbox_area_ratio"], F.col("small_max"), F.col("medium_max")),
        "h": B.horizontal(features["center_x_norm"]),
        "v": B.vertical(features["center_y_norm"]),
        "shape": B.shape(features["aspect_ratio"]),
        "region": B.region(features["center_x_norm"], features["center_y_norm"]),
    }
    said = V.claims(F.col("prompt"))
    return boxed.withColumns({f"_said_{k}": said[k] for k in CLAIM_KINDS} | {f"_shown_{k}": derived[k] for k in CLAIM_KINDS})


def claimed(prompts: DataFrame) -> DataFrame:
    """(… , kind, claimed, derived): every claim of a prompt beside what its decoded target box shows."""
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"_said_{k}").alias("claimed"), F.col(f"_shown_{k}").alias("derived")) for k in CLAIM_KINDS))
    each = _read_claims(prompts).where(F.size("boxes") == 1).withColumn("c", F.explode(every))
    return each.select("*", "c.*").drop("c", *(f"_{of}_{k}" for of in ("said", "shown") for k in CLAIM_KINDS)).where("claimed is not null")


def _problems(rows: DataFrame, found: dict[str, Column], detail: dict[str, Column]) -> DataFrame:
    # the array itself is taken apart, nulls too: Spark would work a filtered one out twice
    each = F.array(*(F.when(when, F.struct(F.lit(kind).alias("problem"), detail.get(kind, F.col("suffix")).alias("detail"))) for kind, when in found.items()))
    kept = rows.select("prompt_group", "split", "name", each.alias("_e")).withColumn("p", F.explode("_e")).where("p is not null")
    return kept.select("prompt_group", "split", "name", "p.problem", "p.detail")


def feature_problems(prompts: DataFrame, uniform: str) -> DataFrame:
    """(prompt_group, split, name, problem, detail) of rows (prompt_group, split, name, prompt, suffix, w, h, size limits, and
    what read_targets adds): box_count (no further check then), no_end, not_in_baseline, negative, features (of the uniform
    group, which states size, shape and region), and claim_ with the kind of a claim that the target box contradicts."""
    rows = _read_claims(prompts).withColumn("one", F.size("boxes") == 1)
    one, said, shown = F.col("one"), {k: F.col(f"_said_{k}") for k in CLAIM_KINDS}, {k: F.col(f"_shown_{k}") for k in CLAIM_KINDS}
    whole = {"box_count": ~one, "no_end": one & ~F.col("suffix").endswith("<eos>"), "not_in_baseline": one & ~F.col("known"), "negative": ~F.col("suffix").contains("<loc")}
    stated = [said[k].isNotNull() if k in ("size", "shape", "region") else said[k].isNull() for k in CLAIM_KINDS]
    whole["features"] = (F.col("prompt_group") == uniform) & ~(stated[0] & stated[1] & stated[2] & stated[3] & stated[4])
    whole |= {f"claim_{k}": one & (said[k] != shown[k]) for k in CLAIM_KINDS}
    return _problems(rows, whole, {"not_in_baseline": F.col("first_loc"), "features": F.col("prompt")} | {f"claim_{k}": F.concat_ws(" / ", said[k], shown[k]) for k in CLAIM_KINDS})


def baseline_problems(rows: DataFrame, prompt: str) -> DataFrame:
    """Like feature_problems, of baseline rows: negative_target (none but the end mark), prompt_text, no_end."""
    suffix = F.col("suffix")
    found = {"negative_target": ~suffix.contains("<loc") & (suffix != "<eos>"), "prompt_text": F.col("prompt") != prompt, "no_end": ~suffix.endswith("<eos>")}
    return _problems(rows, found, {"prompt_text": F.col("prompt")})
