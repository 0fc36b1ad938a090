import itertools
import random

from pyspark.sql import functions as F

from tessera.functions import boxes as B
from tessera.functions import vocabulary as V


def frame(spark, rows):
    return spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double, w double, h double")


def random_boxes(n, seed=3):
    draw = random.Random(seed)
    for h in (512.0, 555.0, 588.0):
        for _ in range(n):
            x0, y0 = draw.uniform(0, 482), draw.uniform(0, h - 30)
            yield x0, y0, draw.uniform(x0 + 5, 512), draw.uniform(y0 + 5, h), 512.0, h


def test_tokens_and_back(spark):
    rows = frame(spark, list(random_boxes(200)))
    w, h = F.col("w"), F.col("h")
    back = rows.withColumn("b", F.get(B.decoded(B.tokens(*B.box().values(), w, h), w, h), F.lit(0)))
    gap = F.greatest(*(F.abs(F.col(f"b.{c}") - F.col(c)) for c in ("x0", "y0", "x1", "y1")))
    assert back.where(gap > F.greatest("w", "h") / 1024 + 1).count() == 0


def test_decoding_with_a_wrong_height_is_far_off(spark):
    rows = frame(spark, [(100.0, 300.0, 200.0, 500.0, 512.0, 555.0)])
    text = B.tokens(*B.box().values(), F.col("w"), F.col("h"))
    got = rows.select(F.get(B.decoded(text, F.lit(512.0), F.lit(512.0)), F.lit(0))["y1"].alias("y1")).first().y1
    assert abs(got - 500) > 20


def test_half_bins_round_to_even(spark):
    rows = frame(spark, [(0.25, 0.75, 1.25, 9000.0, 512.0, 512.0)])
    assert rows.select(B.tokens(*B.box().values(), F.col("w"), F.col("h"))).first()[0] == "<loc0002><loc0000><loc1023><loc0002>"


def test_labels_and_boxes_of_a_text(spark):
    text = "<loc0000><loc0000><loc0512><loc0512> lesion ; <loc0001><loc0002><loc0003><loc0004> other"
    rows = spark.createDataFrame([(text,), ("none",), (None,)], "t string")
    got = [len(r[0]) for r in rows.select(B.decoded(F.col("t"), F.lit(512.0), F.lit(512.0), "lesion")).collect()]
    assert got == [1, 0, 0]


def test_box_errors(spark):
    rows = frame(spark, [(5.0, 5.0, 5.0, 9.0, 512.0, 512.0), (-3.0, 0.0, 9.0, 9.0, 512.0, 512.0), (512.0, 0.0, 512.5, 9.0, 512.0, 512.0), (1.0, 1.0, 512.5, 9.0, 512.0, 512.0)])
    got = [r[0] for r in rows.select(B.box_error(*B.box().values(), F.col("w"), F.col("h"), 1.0)).collect()]
    assert got == ["zero_area_or_inverted_bbox", "bbox_outside_image", "bbox_outside_image", None]


def test_overlap_of_missing_and_touching_boxes(spark):
    rows = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 0.0, 3.0, 2.0)), ((0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0)), (None, (0.0, 0.0, 1.0, 1.0))], "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r[0] for r in rows.select(B.iou(F.col("a"), F.col("b"))).collect()] == [2 / 6, 0.0, 0.0]


def test_every_caption_reads_back_for_every_combination_and_subset(spark):
    levels, axes = ["low", "mid", "high"], ["vertical", "diagonal", "horizontal", "none"]
    combos = [(s, o, u, i, v) for s in levels for o in axes for u in levels for i in levels for v in levels]
    subsets = [list(c) for n in range(1, 6) for c in itertools.combinations(V.FACTS, n)]
    rows = spark.createDataFrame(combos, ", ".join(f"{f} string" for f in V.FACTS)).crossJoin(spark.createDataFrame([(s,) for s in subsets], "facts array<string>"))
    assert rows.count() == 324 * 31
    made = rows.withColumn("caption", V.answer(F.col("facts"), {f: F.col(f) for f in V.FACTS}))
    said = V.parsed(F.col("caption"))
    wrong = F.lit(False)
    for field, got in said.items():
        want = F.when(F.array_contains("facts", field), F.col(field)) if field in V.FACTS else F.lit(None)
        wrong = wrong | ~got.eqNullSafe(want)
    assert made.where(wrong).count() == 0


def test_prompt_words_are_claims(spark):
    rows = spark.createDataFrame([(s, h, v, sh) for s in ("small", "medium", "large") for h in ("left", "center", "right") for v in ("upper", "middle", "lower") for sh in ("wide", "compact", "tall")], "size string, horizontal string, vertical string, shape string")
    rows = rows.withColumn("region", F.concat_ws("-", "vertical", "horizontal"))
    for group, clues in V.CLUES.items():
        text = V.prompt(group, *(F.col(c) for c in ("size", "horizontal", "vertical", "region", "shape")))
        said = V.claims(text)
        if "size" in clues:
            assert rows.where(~said["size"].eqNullSafe(F.col("size"))).count() == 0
        if group == "horizontal":
            assert rows.where(~said["h"].eqNullSafe(F.col("horizontal"))).count() == 0
        if group in ("region", "size_region", "size_shape_region"):
            assert rows.where(~said["region"].eqNullSafe(F.col("region"))).count() == 0


def test_brightness_of_odd_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (-1.5,), (2.0,), (None,)], "z double")
    assert [r[0] for r in rows.select(V.brightness(F.col("z"))).collect()] == ["similar", "similar", "similar", "darker", "brighter", "similar"]


def test_lines_are_as_full_as_they_get(spark):
    import textwrap

    from tessera.functions import scalars

    texts = ["", "one", "a bb ccc dddd", "anextremelylongword a b", "x  y", "aaaa bbbb cccc dddd eeee", "ab " * 40]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for width in (1, 5, 9, 14):
        got = {r.t: r.lines for r in rows.select("t", scalars.wrapped(F.col("t"), width).alias("lines")).collect()}
        assert got == {t: textwrap.wrap(" ".join(t.split()), width, break_long_words=False) or [""] for t in texts}


def test_the_rate_rises_then_falls_to_its_floor(spark):
    import math

    from tessera.functions import scalars

    got = [r.f for r in spark.range(0, 160).select(scalars.rate_factor(F.col("id"), 10, 110, 0.05).alias("f")).orderBy("id").collect()]
    assert got[0] == 0.1 and got[9] == 1.0 and got[10] == 1.0
    assert all(a >= b for a, b in zip(got[10:], got[11:], strict=False)) and set(got[110:]) == {got[110]} and math.isclose(got[110], 0.05)
    assert math.isclose(got[60], 0.05 + 0.95 * 0.5)
    assert [r.f for r in spark.range(3).select(scalars.rate_factor(F.col("id"), 0, 0).alias("f")).collect()][1:] == [0.01, 0.01]
