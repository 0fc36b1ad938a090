"""Steps that large tables go through: what they return, and that they hold and sort no more than they need."""

from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import captions, detection, prompts, sampling
from tessera.plans import adapter as A
from tessera.plans import queries
from tessera.sources import records

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_draws_come_in_runs(spark, monkeypatch):
    long = spark.range(300).select(F.col("id").cast("string").alias("patient"), F.lit("shape").alias("fact"), (F.col("id") % 3 == 0).alias("ok"))
    whole = captions.bootstrap_interval(long, 20).collect()
    monkeypatch.setattr(captions, "DRAW_RUN", 7)
    assert captions.bootstrap_interval(long, 20).collect() == whole and len(whole) == 1


def test_weighted_answers_count_as_often_as_they_stand_for(spark):
    answers = queries._answers(queries._asked(spark, SF))
    counted = queries._counted_answers(spark, SF)
    assert counted.count() < answers.count() == counted.agg(F.sum("weight")).first()[0]
    order = ["prompt_type"]
    assert captions.batch_means(answers).orderBy(order).collect() == captions.batch_means(counted).orderBy(order).collect()
    one = answers.where("prompt_type = 'generic'")
    long, few = captions.facts_long(one), captions.facts_long(captions.answer_counts(one))
    assert captions.right_histogram(long, "lesion_id").orderBy("facts_right").collect() == captions.right_histogram(few, "shape", "orientation", "outline", "intensity", "variation", "pred").orderBy("facts_right").collect()


def test_majority_sorts_no_rows(spark):
    found = captions.majority(A.fact_rows(spark, SF), "lesion_id")
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_predictors_answer_equal_rows_once(spark):
    assert "weight" in plan(queries.n02_predictors(spark, SF))


def test_slice_captions_are_counted_before_they_are_read(spark):
    assert plan(queries.p20_consistency(spark, SF)).count("Aggregate [") >= 2 and "weight" in plan(queries.p20_consistency(spark, SF))


def test_lesion_captions_are_counted_before_they_are_read(spark):
    assert "weight" in plan(queries.p19_parse_roundtrip(spark, SF))


def test_rows_meet_the_interval_that_holds_their_value(spark):
    ends = {"a": [3, 3, 4, 1000], "b": [1, 2]}
    listed = [(k, lo, hi, i) for k, his in ends.items() for i, (lo, hi) in enumerate(zip([0, *his], his))]
    rows = [(k, v) for k, his in ends.items() for v in range(his[-1])]
    got = sampling.in_interval(spark.createDataFrame(rows, "k string, v long"), spark.createDataFrame(listed, "k string, _lo long, _hi long, which int"), ["k"], F.col("v"))
    assert {(r.k, r.v, r.which) for r in got.collect()} == {(k, v, i) for k, v in rows for kk, lo, hi, i in listed if kk == k and lo <= v < hi}
    assert got.count() == len(rows)


def test_draws_meet_no_list_of_all_parts(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 5 + 1).alias("weight"))
    got = sampling.weighted_resample(rows, "k")
    assert got.count() == 500 and "lambdafunction" not in plan(got).lower()


def test_several_schemes_in_one_pass(spark):
    rows = A.fact_rows(spark, SF).select("lesion_id", "patient", "shape", "outline")
    both = sampling.resample_weights(rows, "patient", ["shape", "outline"], ["class", "combo"])
    for scheme in ("class", "combo"):
        one = sampling.resample_weights(rows, "patient", ["shape", "outline"], scheme)
        assert sorted(map(tuple, one.select("lesion_id", "weight").collect())) == sorted(map(tuple, both.select("lesion_id", scheme).collect()))


def test_a_box_is_one_row_whatever_the_levels(spark):
    rows = detection.scored(A.predictions(A.labelled(spark, SF).where("split = 'test'")))
    both = detection.average_precisions(rows, ["image", "ord"], per=64)
    assert both.count() == 2 * 3 * len(detection.LEVELS)
    assert both.where("condition = 'oracle' and level = 50 and ap < 1").count() == 0


def test_prompts_are_counted_before_rows_are_multiplied(spark):
    found = prompts.lesion_prompts(A.labelled(spark, SF), prompts.FEATURE_GROUPS)
    shown = plan(found)
    assert shown.index("Generate explode") < shown.index("collect_list")
    again = found.groupBy("image", "prompt_group", "prompt").agg(F.count("*").alias("n"), F.min("n_same").alias("lo"), F.max("n_same").alias("hi"))
    assert again.where("n <> lo or n <> hi").count() == 0


def test_a_pattern_runs_once_a_text_however_many_words_it_reads(spark):
    texts = [(None,), ("",), ("is highly elongated, has no dominant axis and shows low intensity variation",), ("A compact region with a vertical main axis, moderate outline regularity, high overall intensity",), ("large, middle-left, relatively darker; moderate edge complexity and low texture complexity",), ("elongated small upper-center similar in brightness, no overall intensity",)]
    rows = spark.createDataFrame(texts, "t string")
    for field, (pattern, words) in V.READ.items():
        got, once = V.label_of(F.col("t"), pattern, words), V.worded(V.found(F.col("t"), pattern), words)
        assert rows.where(~got.eqNullSafe(once)).count() == 0, field
        assert plan(rows.select(got.alias("got"))).count("regexp_extract") <= 2 - bool(words), field


def test_clauses_are_marked_in_one_reading(spark):
    shown = plan(queries.p32_marked_clauses(spark, SF))
    assert shown.count("regexp_extract") == 5 and "explicit_full" not in shown and shown.count("lambda") < 20


def test_shards_are_written_from_one_pass_over_the_rows(spark, monkeypatch):
    written, write = [], records.write_lines
    monkeypatch.setattr(records, "write_lines", lambda rows, *a, **b: (written.append(plan(rows)), write(rows, *a, **b)))
    found = queries.s07_shards_last_wins(spark, SF)
    assert len(written) == 1 and written[0].count("Relation [l_") == 1
    rows = A.predictions(A.labelled(spark, SF).where("split = 'test'")).select("condition", "lesion_id", (F.col("pk") % 3).alias("shard"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    files = found.inputFiles()
    assert {f.split("answers_shard=")[1][0] for f in files if f.endswith(".gz")} == set("012")


def test_shards_without_any_row_are_read_as_none(spark, tmp_path):
    spark.read.parquet(f"{SF}/orders.parquet").where("o_custkey % 79 < 55").write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert queries.s07_shards_last_wins(spark, str(tmp_path)).count() == 0
