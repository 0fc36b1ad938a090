import json
import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import captions, detection, models, pixels, prompts, sampling, text
from tessera.plans import adapter as A
from tessera.sources import images, records
from tessera.streaming import evaluator

SF = "/root/testdata/sf0.001"


def test_oracle_scores_one_and_majority_scores_its_baseline(spark):
    rows = A.fact_rows(spark, SF)
    train, test = rows.where("split = 'train'"), captions.prompt_types(rows.where("split = 'test'"))
    best = captions.majority(train, "lesion_id")
    truth = captions.facts_long(models.oracle(test))
    assert truth.where("not ok").count() == 0
    said = captions.facts_long(models.majority_answers(test, best))
    classes = best.select("fact", F.lit(3).alias("classes"))
    assert captions.fact_accuracy(said, best, classes).where("accuracy <> baseline").count() == 0


def test_oracle_boxes_have_full_precision(spark):
    rows = detection.scored(A.predictions(A.labelled(spark, SF).where("split = 'test'"))).where("condition = 'oracle'")
    got = detection.mean_average_precision(detection.average_precision(rows, ["image", "ord"], per=64)).first()
    assert got.map50 == 1.0 and got.map75 > 0.95


def test_hints_always_mislead(spark):
    rows = A.labelled(spark, SF).select("lesion_id", "size", "region")
    got = prompts.mismatched(rows)
    assert got.count() == rows.count()
    assert got.where("region = hint_region or size = hint_size").count() == 0


def test_weighted_resample_follows_the_weights(spark):
    rows = spark.createDataFrame([(f"a{i}", "a") for i in range(100)] + [("b0", "b")], "k string, g string")
    drawn = sampling.weighted_resample(sampling.resample_weights(rows, "g"), "k", draws=4000).groupBy(F.substring("k", 1, 1).alias("g")).count().collect()
    share = {r.g: r["count"] for r in drawn}
    assert sum(share.values()) == 4000 and 0.06 < share["b"] / 4000 < 0.13  # weights 100 / 10 to 1


def test_weighted_resample_is_as_large_as_its_rows(spark):
    rows = spark.createDataFrame([("a" if i < 9 else "b", f"k{i}") for i in range(6007)], "g string, k string")
    drawn = sampling.weighted_resample(sampling.resample_weights(rows, "g"), "k")
    assert drawn.count() == drawn.select("draw").distinct().count() == 6007
    assert drawn.join(rows, "k", "left_semi").count() == 6007
    assert sampling.weighted_resample(sampling.resample_weights(rows.limit(0), "g"), "k").count() == 0


def test_natural_order_and_patients(spark):
    names = ["p10_2.png", "p9_10.png", "p9_2.png", "P9_02.png", "p9_1a.png", "q1.png", "007_x", "7_a", "12"]
    key = lambda s: [(0, int(t)) if t.isdigit() else (1, t) for t in __import__("re").findall(r"\d+|\D+", s.lower())]
    rows = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", sampling.natural_key(F.col("n")))
    got = [r.n for r in rows.orderBy("k", "n").collect()]
    assert got == sorted(names, key=lambda n: (key(n), n))
    assert [r.p for r in rows.orderBy("k", "n").select(sampling.patient_of(F.col("n")).alias("p")).collect()] == [n.split("_")[0] for n in got]


def test_numbering_by_blocks_is_the_global_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("v"))
    got = sampling.numbered(rows, ["v"], F.floor(F.col("v") / 1000)).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1000)) and [r.v for r in got] == sorted(r.v for r in got)


def test_components_against_flood_fill(spark):
    draw = random.Random(5)
    grid = {(i, x, y): draw.random() < 0.45 for i in range(6) for x in range(14) for y in range(11)}
    rows = spark.createDataFrame([(i, x, y, 0, fg) for (i, x, y), fg in grid.items()], "id long, x long, y long, g long, fg boolean")
    got = {(r.id, r.x, r.y): r.blob for r in pixels.components(rows).collect()}
    seen = {}
    for (i, x, y), fg in grid.items():
        if fg and (i, x, y) not in seen:
            stack, part = [(i, x, y)], []
            seen[(i, x, y)] = None
            while stack:
                _, a, b = p = stack.pop()
                part.append(p)
                for q in ((i, a + dx, b + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
                    if grid.get(q) and q not in seen:
                        seen[q] = None
                        stack.append(q)
            name = min(b * (1 << 20) + a for _, a, b in part)
            for p in part:
                seen[p] = name
    assert got == seen


def test_hull_of_a_line_a_point_and_a_triangle(spark):
    cells = {0: {(1, 1)}, 1: {(0, 0), (2, 2)}, 2: {(0, 0), (4, 0), (0, 4)}}
    rows = [(i, x, y, 0, (x, y) in fg) for i, fg in cells.items() for x in range(5) for y in range(5)]
    got = {r.id: (r.area, r.hull) for r in pixels.solidity(spark.createDataFrame(rows, "id long, x long, y long, g long, fg boolean")).collect()}
    assert got == {0: (1, 1), 1: (2, 3), 2: (3, 15)}


def test_measures_turn_with_the_image(spark):
    rows = [(0, x, y, 200, 2 <= x <= 9 and 4 <= y <= 6) for x in range(12) for y in range(12)]
    turned = [(1, y, 11 - x, g, fg) for _, x, y, g, fg in rows]
    got = {r.id: r for r in pixels.shape_moments(spark.createDataFrame(rows + turned, "id long, x long, y long, g long, fg boolean")).withColumn("o", V.orientation(F.col("angle"), F.col("axis_ratio"))).collect()}
    assert (got[0].o, got[1].o) == ("horizontal", "vertical") and abs(got[0].axis_ratio - got[1].axis_ratio) < 1e-9


def test_rouge_and_similarity_of_edge_cases(spark):
    rows = spark.createDataFrame([(0, "a b c d", "a c d"), (1, "", "a"), (2, "a", ""), (3, "A b", "a B<eos>"), (4, "x", "y")], "k long, ref string, hyp string")
    got = {r.k: (r.lcs, r.rouge_l) for r in text.rouge_l(rows).collect()}
    assert got == {0: (3, 6 / 7), 1: (0, 0.0), 2: (0, 0.0), 3: (2, 1.0), 4: (0, 0.0)}
    assert {r.k: round(r.ratio, 4) for r in text.similarity(rows, "k").collect()}[0] == round(6 / 7, 4)


def test_average_precision_of_a_known_ranking(spark):
    box, off = (0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 60.0, 60.0)
    kind = "condition string, image long, ord int, x0 double, y0 double, x1 double, y1 double, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>"
    rows = spark.createDataFrame([("c", 0, 1, *box, [box]), ("c", 1, 1, *box, [off]), ("c", 2, 1, *box, [off, box]), ("c", 3, 1, *box, [])], kind)
    got = {r.level: r.ap for r in detection.average_precision(rows, ["image", "ord"], per=2).collect()}
    # hits at ranks 1 and 4: recall .25 at precision 1, .5 at precision .5
    assert abs(got[50] - (26 * 1.0 + 25 * 0.5) / 101) < 1e-6


def png(path, rows):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_are_read_as_grey_pixels(spark, tmp_path):
    png(tmp_path / "a.png", [[(255, 0, 0), (0, 255, 0), (0, 0, 255)], [(10, 10, 10), (255, 255, 255), (0, 0, 0)]])
    found = images.read_images(spark, str(tmp_path))
    grey = {(r.x, r.y): r.g for r in images.grey_pixels(found).collect()}
    assert [grey[(x, 0)] for x in range(3)] == [76, 150, 29] and grey[(0, 1)] == 10 and grey[(1, 1)] == 255
    assert {r.g for r in images.grey_pixels(found, "max").where("y = 0").collect()} == {255}
    sizes = images.image_sizes(spark, str(tmp_path))
    assert tuple(sizes.first()) == ("a.png", 3, 2)
    assert images.turned(images.grey_pixels(found), sizes, 4).exceptAll(images.grey_pixels(found)).count() == 0
    assert records.list_files(spark, str(tmp_path)).first().name == "a.png"


def test_records_come_back_as_written(spark, tmp_path):
    document = {"images": [{"id": 1, "file_name": "7_a.png", "width": 512, "height": 555}, {"id": 2, "file_name": "b.png", "width": 5, "height": 5}], "annotations": [{"id": 9, "image_id": 1, "bbox": [1.5, 2.0, 3.0, 4.0], "category_id": 1}, {"id": 10, "image_id": 99, "bbox": [0, 0, 1, 1], "category_id": 1}]}
    (tmp_path / "coco.json").write_text(json.dumps(document))
    found, boxes = records.read_coco(spark, str(tmp_path / "coco.json"), "train")
    assert found.count() == 2 and tuple(boxes.where("ann_id = 9").first())[3:] == (1.5, 2.0, 4.5, 6.0)
    rows = spark.createDataFrame([("size", "train", "a.png", "p", "s"), ("size", "test", "b.png", "p", "")], "prompt_group string, split string, image string, prefix string, suffix string")
    counts = {r.split: (r.written, r.skipped) for r in records.write_datasets(rows, str(tmp_path / "out")).collect()}
    assert counts == {"train": (1, 0), "test": (0, 1)}
    assert records.read_lines(spark, str(tmp_path / "out/prompt_group=size/split=train/*.json"), records.TRAINING_ROW).first().image == "a.png"
    records.write_features(spark.createDataFrame([(1 / 3, "x")], "a double, b string"), str(tmp_path / "f"), ["b", "a"], 6)
    assert tuple(records.read_table(spark, str(tmp_path / "f"), "b string, a double").first()) == ("x", 0.333333)
    records.write_config(spark.createDataFrame([(0.1, 0.2)], "small_max double, medium_max double"), str(tmp_path / "thr"))
    assert tuple(records.read_config(spark, str(tmp_path / "thr"), "small_max double, medium_max double").first()) == (0.1, 0.2)
    (tmp_path / "r.txt").write_text("mean 0.5 n 3\nmean 0.25 n 4\n")
    assert [tuple(r) for r in records.read_report(spark, str(tmp_path / "r.txt"), r"mean ([0-9.]+) n (\d+)", ["mean", "n"]).collect()] == [("0.5", "3"), ("0.25", "4")]


def test_streamed_answers_add_up_to_the_batch(spark, tmp_path):
    rows = captions.prompt_types(A.fact_rows(spark, SF).where("split = 'test'")).transform(models.oracle).limit(300)
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = evaluator.running_accuracy(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.prompt_type, r.fact): (r.n, r.right) for r in spark.table("running").collect()}
    want = {(r.prompt_type, r.fact): (r.n, r.n) for r in captions.facts_long(spark.read.schema(rows.schema).json(str(tmp_path / "in"))).groupBy("prompt_type", "fact").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_windows_of_events(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = evaluator.windowed_counts(stream, "ts", "event_type", late="36500 days").writeStream.outputMode("complete").format("memory").queryName("wins").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("wins").agg(F.sum("n")).first()[0] == events.count()


def test_predictor_function_over_batches(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, prompt string")
    assert {r.pred for r in models.predict(rows, lambda b: b["prompt"] + "!").collect()} == {"a!", "b!"}
    models.register_metric("rows", lambda df: df.agg(F.count("*").alias("n")))
    assert models.measure("rows", rows).first().n == 2


def test_bootstrap_holds_the_mean(spark):
    draw = np.random.default_rng(2)
    rows = spark.createDataFrame([(f"p{i % 20}", "shape", bool(draw.random() < 0.8)) for i in range(400)], "patient string, fact string, ok boolean")
    got, mean = captions.bootstrap_interval(rows, 100).first(), rows.agg(F.avg(F.col("ok").cast("int"))).first()[0]
    assert got.lo_millionths / 1e6 < mean < got.hi_millionths / 1e6


def test_given_settings_win(spark):
    assert records.settings("epochs: 3\nvariant: full\n", epochs=5, variant=None) == {"epochs": 5, "variant": "full"}
    assert records.settings('{"a": [1, 2]}', b=0) == {"a": [1, 2], "b": 0} and records.settings("") == {}


def test_annotation_documents_of_a_bounded_size(spark, tmp_path):
    names = spark.createDataFrame([("train", 1, "a.png", 5, 6), ("train", 9, "b.png", 5, 6), ("test", 2, "c.png", 7, 7)], "split string, image_id long, name string, w int, h int")
    boxes = spark.createDataFrame([("train", 1, 11, 1, 0.0, 1.0, 2.0, 3.0), ("train", 30, 12, 1, 0.0, 0.0, 1.0, 1.0)], "split string, image_id long, ann_id long, category_id int, x double, y double, width double, height double")
    records.write_coco(names, boxes, str(tmp_path / "c"), images_a_document=8)
    assert sorted(p.parent.name for p in (tmp_path / "c/split=train").glob("*/*.json")) == ["part=0", "part=1", "part=3"]
    found, back = records.read_coco(spark, str(tmp_path / "c/split=train"), "train")
    assert sorted(tuple(r) for r in found.collect()) == [("train", 1, "a.png", 5, 6), ("train", 9, "b.png", 5, 6)]
    assert sorted(tuple(r) for r in back.collect()) == [(11, 1, 1, 0.0, 1.0, 2.0, 4.0), (12, 30, 1, 0.0, 0.0, 1.0, 1.0)]


def test_markdown_lines_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "k string, n long")
    assert [r.line for r in records.markdown(rows, ["k", "n"]).orderBy("line").collect()] == ["|  | 2 |", "| a | 1 |"]
    assert records.heading(["k", "n"]) == "| k | n |\n|---|---|"


def test_every_kind_of_problem_is_found(spark):
    from tessera.plans import queries

    found = {r.problem for r in queries.g23_problems(spark, SF).collect()}
    assert found == {"box_count", "no_end", "not_in_baseline", "negative", "features", "negative_target", "prompt_text", *(f"claim_{k}" for k in ("size", "h", "v", "shape", "region"))}
