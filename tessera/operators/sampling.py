"""Sampling and resampling by hashes: the same draws on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F


def hashed(*key, salt: str = "") -> Column:
    """A whole number below 2^32 from the first 32 bits of a SHA-1."""
    return F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(salt), *key)), 1, 8), 16, 10).cast("long")


def hash_sample(rows: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """n rows without replacement, least hash first: a top-k, never a full sort."""
    return rows.orderBy(F.sha1(F.concat_ws(":", F.lit(salt), key)), key).limit(n)


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Win.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def limit_per(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group. A window group limit cuts them before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Win.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def numbered(rows: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Adds idx, 0.. in the order of (block, *order). block (a number or text that grows with the order) deals the work: rows
    are numbered within blocks, and the blocks' sizes are summed along a short list."""
    inside = rows.withColumn("_b", block).withColumn("_r", F.row_number().over(Win.partitionBy("_b").orderBy(*order)))
    sizes = inside.groupBy("_b").agg(F.count("*").alias("_c"))
    starts = sizes.select("_b", F.coalesce(F.sum("_c").over(Win.orderBy("_b").rowsBetween(Win.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return inside.join(starts, "_b").withColumn("idx", F.col("_s") + F.col("_r") - 1).drop("_b", "_r", "_s")


def stride(indexed: DataFrame, k: int) -> DataFrame:
    return indexed.where(F.col("idx") % k == 0)


def shard(indexed: DataFrame, shards: int) -> DataFrame:
    return indexed.withColumn("shard", (F.col("idx") % shards).cast("int"))


def resample_weights(rows: DataFrame, patient: str, facts: list[str] = (), scheme: str | list[str] = "patient", patient_power: float = 0.5, combo_power: float = 0.5) -> DataFrame:
    """Adds weight, in whole millionths: patient count to -patient_power, times, for the scheme "combo", the count of the
    facts' combination to -combo_power, or, for "class", the mean over facts of rows / (levels * rows of the level).
    Several schemes make a column each, named as they are."""
    power = lambda n, by: F.pow(n.cast("double"), F.lit(-by))
    schemes = {"weight": scheme} if isinstance(scheme, str) else {s: s for s in scheme}
    if unknown := set(schemes.values()) - {"patient", "combo", "class"}:
        raise ValueError(f"no scheme {', '.join(unknown)}: patient, combo or class")
    found = rows.withColumn("_g", F.count("*").over(Win.partitionBy(patient))).where(F.col(patient).isNotNull())
    weights = {"patient": (one := power(F.col("_g"), patient_power))}
    if set(schemes.values()) - {"patient"}:
        found = found.join(F.broadcast(_combinations(rows, facts)), list(facts))
        shares = sum((F.col("_n") / (F.col(f"_k_{f}") * F.col(f"_f_{f}")) for f in facts), F.lit(0.0))
        weights |= {"combo": one * power(F.col("_c"), combo_power), "class": one * shares / len(facts)}
    return found.select(*rows.columns, *(F.floor(1e6 * weights[s] + 0.5).cast("long").alias(name) for name, s in schemes.items()))


def _combinations(rows: DataFrame, facts: list[str]) -> DataFrame:
    """(facts, _c rows of the combination, _n rows, and of each fact _k_ levels and _f_ rows of the level): one counting of the
    rows; combinations are few, by vocabulary."""
    counted = rows.groupBy(*facts).agg(F.count("*").alias("_c"))
    whole = Win.partitionBy()
    of = {"_n": F.sum("_c").over(whole)} | {f"_k_{f}": F.size(F.collect_set(f).over(whole)).cast("long") for f in facts} | {f"_f_{f}": F.sum("_c").over(Win.partitionBy(f)) for f in facts}
    return counted.withColumns(of)


def in_interval(rows: DataFrame, intervals: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Each row with its value (_v; of its columns and _total, the end of its keys' last interval) and the interval (keys,
    _lo, _hi and more; from 0 without gaps; a short list) that holds it. The range is cut into as many equal bins as there
    are intervals, so that a row meets those of its bin alone."""
    ends = intervals.groupBy(*keys).agg(F.max("_hi").alias("_total"), F.greatest(F.ceil(F.max("_hi") / F.count("*")), F.lit(1)).cast("long").alias("_width"))
    beside = lambda some: some.join(F.broadcast(ends), keys) if keys else some.crossJoin(F.broadcast(ends))
    binned = beside(intervals.where("_hi > _lo")).withColumn("_bin", F.explode(F.expr("sequence(_lo div _width, (_hi - 1) div _width)"))).drop("_total", "_width")
    valued = beside(rows).withColumn("_v", value).withColumn("_bin", F.expr("_v div _width")).drop("_total", "_width")
    return valued.join(F.broadcast(binned), [*keys, "_bin"]).where("_v >= _lo and _v < _hi").drop("_bin")


#: Rows that a part of a resample is meant to hold; parts are 64 at least and PARTS at most.
PART_ROWS, PARTS = 50_000, 1 << 16


def weighted_resample(rows: DataFrame, key: str, weight: str = "weight", draws: int | None = None) -> DataFrame:
    """draws rows (as many as there are, if not given) with replacement by a column of whole weights.

    Cumulative weights go by part (hash of the key; their number grows with the rows): a draw falls into a part by the
    list of the parts' totals, and meets the row whose interval holds it among the rows of that part. No draw is compared
    with all rows or parts.
    """
    n = rows.count()
    parts = min(PARTS, max(64, n // PART_ROWS))
    weighted = rows.withColumn("_w", F.col(weight)).withColumn("_p", (hashed(F.col(key), salt="part") % parts).cast("int"))
    along = Win.partitionBy("_p").orderBy(key).rowsBetween(Win.unboundedPreceding, 0)
    placed = weighted.select(key, "_w", "_p").withColumn("_hi", F.sum("_w").over(along))
    # a part's total is its last sum, from the same shuffle; listed in one row, it is found once
    totals = placed.groupBy("_p").agg(F.max("_hi").alias("_t")).agg(F.collect_list(F.struct("_p", "_t")).alias("_e")).select(F.inline("_e"))
    upto = Win.orderBy("_p").rowsBetween(Win.unboundedPreceding, 0)  # parts rows
    own = totals.withColumn("_hi", F.sum("_t").over(upto)).select("_p", (F.col("_hi") - F.col("_t")).alias("_lo"), "_hi")
    drawn = rows.sparkSession.range(n if draws is None else draws).select(F.col("id").alias("draw"))
    # two hashes make 62 bits, so that the modulus is even
    value = (hashed(F.col("draw"), salt="a") * F.lit(1 << 30) + hashed(F.col("draw"), salt="b") % (1 << 30)) % F.col("_total")
    drawn = in_interval(drawn, own, [], value).select("draw", "_p", (F.col("_v") - F.col("_lo")).alias("_at"))
    # the row whose interval holds the draw: draws and interval ends merged in one falling order, each draw takes the last row
    both = placed.select("_p", F.col("_hi").alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("draw"), F.col(key).alias("_key")).unionByName(drawn.select("_p", (F.col("_at") + 1).alias("_x"), F.lit(0).alias("_kind"), "draw", F.lit(None).cast(dict(rows.dtypes)[key]).alias("_key")))
    behind = Win.partitionBy("_p").orderBy(F.desc("_x"), F.desc("_kind")).rowsBetween(Win.unboundedPreceding, 0)
    return both.withColumn("_hit", F.last("_key", ignorenulls=True).over(behind)).where("_kind = 0").select("draw", F.col("_hit").alias(key))


def fact_subset(rows: DataFrame, key: str, facts: list[str], all_share: int = 4) -> DataFrame:
    """Adds facts: all of them for one row in all_share, else 1 to len - 1 of them, in canonical order."""
    n = len(facts)
    size = F.when(hashed(F.col(key), salt="all") % all_share == 0, n).otherwise((hashed(F.col(key), salt="k") % (n - 1) + 1).cast("int"))
    ranked = F.array_sort(F.array(*(F.struct(F.sha1(F.concat_ws(":", F.lit("fact"), F.lit(f), key)).alias("h"), F.lit(k).alias("k"), F.lit(f).alias("f")) for k, f in enumerate(facts))))
    kept = F.array_sort(F.transform(F.slice(ranked, F.lit(1), size), lambda e: F.struct(e["k"].alias("k"), e["f"].alias("f"))))
    return rows.withColumn("facts", F.transform(kept, lambda e: e["f"]))


def natural_key(text: Column) -> Column:
    """Sorts texts with the numbers in them as numbers: every run of digits goes behind its length (up to 999 digits)."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|[^\d]+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(p)).cast("string"), 3, "0"), bare(p))).otherwise(p)), "")


def patient_of(name: Column) -> Column:
    """A file name's patient: what stands before the first underscore."""
    return F.split_part(name, F.lit("_"), F.lit(1))
