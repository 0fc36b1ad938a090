"""Evaluation of stated facts: accuracy, balance, confusion, histograms, confidence intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.boxes import millionths
from tessera.operators import sampling

#: Facts that are ordered, and the place of each level.
ORDER = {"shape": ("low", "mid", "high"), "outline": ("low", "mid", "high"), "intensity": ("low", "mid", "high"), "variation": ("low", "mid", "high"), "orientation": ("vertical", "diagonal", "horizontal")}
NONE = "none stated"


def prompt_types(rows: DataFrame, only: str | None = None) -> DataFrame:
    """rows x (generic, explicit_full and one prompt per fact), or one of these alone, with the facts each asks for."""
    facts = lambda names: F.array(*(F.lit(n) for n in names))
    listed = [("generic", V.FACTS), ("explicit_full", V.FACTS), *((f"single_{f}", [f]) for f in V.FACTS)]
    listed = [(n, f) for n, f in listed if only in (None, n)]
    every = F.array(*(F.struct(F.lit(n).alias("prompt_type"), facts(f).alias("facts")) for n, f in listed))
    each = rows.withColumn("t", F.explode(every)).select("*", "t.*").drop("t")
    return each.withColumn("prompt", F.when(F.col("prompt_type") == "explicit_full", V.explicit_question()).otherwise(V.question(F.col("facts"))))


def majority(train: DataFrame, order: str) -> DataFrame:
    """(fact, label): the most frequent training label; the first seen (least order) wins ties."""
    long = train.select(order, *[F.col(f) for f in V.FACTS]).select(order, F.explode(F.array(*(F.struct(F.lit(f).alias("fact"), F.col(f).alias("label")) for f in V.FACTS))).alias("e")).select(order, "e.*")
    # a least text alone makes Spark sort all rows; beside an aggregate that is an object (of one number here) it is hashed
    least = F.when(F.size(F.collect_set(F.lit(0))) > 0, F.min(order))
    counted = long.groupBy("fact", "label").agg(F.count("*").alias("n"), least.alias("first"))
    return counted.withColumn("r", F.row_number().over(Win.partitionBy("fact").orderBy(F.desc("n"), "first"))).where("r = 1").select("fact", "label", "n")


def answer_counts(answers: DataFrame, *keys: str) -> DataFrame:
    """Equal answers to equal questions about equal labels (and equal keys) once, with their number as weight: there are
    few distinct texts, and reading one takes dozens of patterns."""
    return weighted(answers).groupBy("prompt_type", "facts", *V.FACTS, "pred", *keys).agg(_n().alias("weight"))


def weighted(rows: DataFrame) -> DataFrame:
    """rows with a weight: 1 where they have none."""
    return rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1).cast("long"))


def _n():
    return F.sum("weight")


def _n_if(condition):
    return F.sum(F.when(condition, F.col("weight")).otherwise(0))


def facts_long(answers: DataFrame) -> DataFrame:
    """One row per answer and fact asked for: truth, got (null if not stated), ok, and weight (1 if answers have none)."""
    answers = weighted(answers)
    said = V.parsed(V.clean(F.col("pred")))
    every = F.array(*(F.struct(F.lit(f).alias("fact"), F.col(f).alias("truth"), said[f].alias("got")) for f in V.FACTS))
    asked = F.filter(every, lambda e: F.array_contains(F.col("facts"), e["fact"]))
    long = answers.withColumn("e", F.explode(asked)).select("*", "e.*").drop("e")
    return long.withColumn("ok", F.coalesce(F.col("got") == F.col("truth"), F.lit(False)))


def fact_accuracy(long: DataFrame, best: DataFrame, classes: DataFrame) -> DataFrame:
    """(prompt_type, fact, n, accuracy, stated, baseline, chance); best and classes have one row per fact."""
    n = _n()
    joined = weighted(long).join(F.broadcast(best.select("fact", F.col("label").alias("major"))), "fact").join(F.broadcast(classes), "fact")
    share = lambda c: _n_if(c) / n
    return joined.groupBy("prompt_type", "fact").agg(n.alias("n"), share(F.col("ok")).alias("accuracy"), share(F.col("got").isNotNull()).alias("stated"), share(F.col("truth") == F.col("major")).alias("baseline"), (F.lit(1.0) / F.max("classes")).alias("chance"))


def balanced_accuracy(long: DataFrame) -> DataFrame:
    """(prompt_type, fact, balanced): mean over the true classes of their recall."""
    per_class = weighted(long).groupBy("prompt_type", "fact", "truth").agg((_n_if(F.col("ok")) / _n()).alias("recall"))
    return per_class.groupBy("prompt_type", "fact").agg((F.sum(F.floor(F.col("recall") * 1e6 + 0.5).cast("long")) / (F.count("*") * 1e6)).alias("balanced"))


def _rank(fact, label):
    out = F.lit(None).cast("int")
    for name, levels in ORDER.items():
        for k, level in enumerate(levels):
            out = F.when((fact == name) & (label == level), k).otherwise(out)
    return out


def ordinal_stats(long: DataFrame) -> DataFrame:
    """(prompt_type, fact, n, within_one, level_error) of the pairs where both sides have a place in the order."""
    gap = F.abs(_rank(F.col("fact"), F.col("truth")) - _rank(F.col("fact"), F.col("got")))
    ranked = weighted(long).withColumn("gap", gap).where("gap is not null")
    return ranked.groupBy("prompt_type", "fact").agg(_n().alias("n"), (_n_if(F.col("gap") <= 1) / _n()).alias("within_one"), (F.sum(F.col("gap") * F.col("weight")) / _n()).alias("level_error"))


def confusion(long: DataFrame) -> DataFrame:
    """(fact, truth, one column per possible answer), zero-filled."""
    answers = ["low", "mid", "high", "vertical", "diagonal", "horizontal", "none", NONE]
    answered = weighted(long).select("fact", "truth", F.coalesce("got", F.lit(NONE)).alias("answered"), "weight")
    wide = answered.groupBy("fact", "truth").pivot("answered", answers).agg(_n()).na.fill(0)
    return wide.withColumnRenamed(NONE, "none_stated").withColumnRenamed("none", "no_axis")


def right_histogram(long: DataFrame, *keys: str) -> DataFrame:
    """(facts_right 0..5, n), zero-filled; keys tell answers (each as often as its weight) apart."""
    per_row = weighted(long).groupBy(*keys).agg(F.count_if("ok").alias("facts_right"), F.max("weight").alias("weight")).groupBy("facts_right").agg(_n().alias("n"))
    every = long.sparkSession.range(len(V.FACTS) + 1).select(F.col("id").alias("facts_right"))
    return every.join(F.broadcast(per_row), "facts_right", "left").select("facts_right", F.coalesce("n", F.lit(0)).alias("n"))


def exact_rates(answers: DataFrame) -> DataFrame:
    """(n, same_text, same_facts): the answer is the reference caption; it states exactly the labels and nothing else."""
    said = V.parsed(V.clean(F.col("pred")))
    same = F.lit(True)
    for field, got in said.items():
        same = same & (got.eqNullSafe(F.col(field)) if field in V.FACTS else got.isNull())
    every = F.array(*(F.lit(f) for f in V.FACTS))
    reference = V.answer(every, {f: F.col(f) for f in V.FACTS})
    n = F.count("*")
    return answers.agg(n.alias("n"), (F.count_if(V.clean(F.col("pred")) == reference) / n).alias("same_text"), (F.count_if(same) / n).alias("same_facts"))


def top_errors(long: DataFrame, k: int = 4) -> DataFrame:
    """(fact, truth, answered, n, place) of the k most frequent wrong answers of each fact."""
    wrong = weighted(long).where("not ok").groupBy("fact", "truth", F.coalesce("got", F.lit(NONE)).alias("answered")).agg(_n().alias("n"))
    return wrong.withColumn("place", F.row_number().over(Win.partitionBy("fact").orderBy(F.desc("n"), "truth", "answered"))).where(F.col("place") <= k)


#: Tasks that lay out a bootstrap's draws, and draws in a run.
DRAW_TASKS, DRAW_RUN = 96, 1 << 16


def bootstrap_interval(long: DataFrame, replicates: int = 500) -> DataFrame:
    """(fact, lo_millionths, hi_millionths): percentiles 2.5 and 97.5 of the accuracy over patients drawn with replacement.

    Draw i of replicate r is patient number hash(r, i) mod patients. Rows are first summed per patient and fact.
    """
    n_if = lambda when: F.coalesce(_n_if(when), F.lit(0))
    counts = [c for k, f in enumerate(V.FACTS) for c in (n_if((F.col("fact") == f) & F.col("ok")).alias(f"right{k}"), n_if(F.col("fact") == f).alias(f"n{k}"))]
    per = weighted(long).groupBy("patient").agg(*counts)
    numbered = sampling.numbered(per, ["patient"], F.substring("patient", 1, 2)).drop("patient")
    draws = long.sparkSession.range(0, replicates, 1, min(replicates, DRAW_TASKS)).select(F.col("id").alias("r"))
    count = per.agg(F.count("*").alias("patients"))
    # a replicate's draws are laid out by runs, so that no array holds them all
    run, last = F.lit(DRAW_RUN).cast("long"), F.col("patients")
    runs = draws.crossJoin(F.broadcast(count)).where("patients > 0").withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), last, run)))
    drawn = runs.withColumn("i", F.explode(F.sequence("from", F.least(F.col("from") + run - 1, last))))
    number = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit("boot"), "r", "i")), 1, 8), 16, 10).cast("long") % F.col("patients")
    # each draw meets its patient's row once, in no order; neither side is sent to the driver
    met = drawn.select("r", number.alias("idx")).join(numbered.hint("shuffle_hash"), "idx")
    sums = met.groupBy("r").agg(*(F.sum(f"{c}{k}").alias(f"{c}{k}") for k in range(len(V.FACTS)) for c in ("right", "n")))
    each = F.array(*(F.struct(F.lit(f).alias("fact"), F.try_divide(f"right{k}", f"n{k}").alias("mean"), F.col(f"n{k}").alias("n")) for k, f in enumerate(V.FACTS)))
    means = sums.select("r", F.inline(each)).where("n > 0")
    return means.groupBy("fact").agg(*(millionths(F.percentile("mean", F.lit(q))).alias(f"{side}_millionths") for side, q in (("lo", 0.025), ("hi", 0.975))))


def batch_means(answers: DataFrame) -> DataFrame:
    """(prompt_type, n, feat_acc, rouge_l): means over answers (each as often as its weight) of the share of the asked facts
    that are right, and of ROUGE-L against the reference caption, to the millionth."""
    from tessera.operators.text import rouge_l

    answers = weighted(answers)
    answers = answers.withColumns({f"_said_{f}": c for f, c in V.parsed(V.clean(F.col("pred"))).items() if f in V.FACTS})
    said = {f: F.col(f"_said_{f}") for f in V.FACTS}
    right = sum((F.when(F.array_contains("facts", f) & F.coalesce(said[f] == F.col(f), F.lit(False)), 1).otherwise(0) for f in V.FACTS[1:]), F.when(F.array_contains("facts", V.FACTS[0]) & F.coalesce(said[V.FACTS[0]] == F.col(V.FACTS[0]), F.lit(False)), 1).otherwise(0))
    pairs = answers.select("weight", "prompt_type", (right / F.size("facts")).alias("accuracy"), V.answer(F.col("facts"), {f: F.col(f) for f in V.FACTS}).alias("ref"), F.col("pred").alias("hyp"))
    mean = lambda c: F.sum(millionths(F.col(c)) * F.col("weight")) / (_n() * 1e6)
    return rouge_l(pairs).groupBy("prompt_type").agg(_n().alias("n"), mean("accuracy").alias("feat_acc"), mean("rouge_l").alias("rouge_l"))


def marked(answers: DataFrame, key: str) -> DataFrame:
    """(key, marked): the answer's clauses in order, wrong ones in brackets, missing ones named."""
    said = V.parsed(V.clean(F.col("pred")))

    read = answers.withColumns({f"_said_{f}": said[f] for f in V.FACTS})

    def shown(f):
        label = F.col(f"_said_{f}")
        got = V.clause(f, label)
        return F.when(label.isNull(), F.lit(f"{f} (not stated)")).when(label != F.col(f), F.concat(F.lit("[["), got, F.lit("]]"))).otherwise(got)

    return read.select(key, F.array_join(F.array(*(shown(f) for f in V.FACTS)), "; ").alias("marked"))
