"""Inputs of box jobs are made once, small groups are folded without cells or tables."""

from pyspark.sql import functions as F

from blockflow.operators import blocks as bl
from blockflow.operators import joins as jo
from blockflow.operators import score as sc
from blockflow.plans import pages as pl

BOXES = ("page_id bigint, block_id bigint, x bigint, y bigint, w bigint, h bigint, text string, "
         "confidence double, type string")


def made(df) -> int:
    """How often a plan works out the column that stands for costly inputs."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("pmod(")


def boxes(spark):
    rows = [(1, i, 10, i * 30, 200, 20, f"line number {i} of some text", 0.5 + i / 100, "text")
            for i in range(6)]
    return spark.createDataFrame(rows, BOXES).withColumn("x", F.pmod(F.col("x"), F.lit(700)))


def sizes(spark):
    return spark.createDataFrame([(1, 1130, 400)], "page_id bigint, page_w bigint, page_h bigint")


def test_detections_and_gold_are_made_once(spark):
    given = boxes(spark).withColumn("cls", F.lit(0))
    scores = sc.page_scores(given.withColumnRenamed("block_id", "gold_id"),
                            given.withColumnRenamed("block_id", "det_id"), sizes(spark))
    assert made(scores) == 0
    r = scores.first()
    assert (r.gold, r.detections, r.hits, r.fns, r.fps) == (6, 6, 6, 0, 0)


def test_labels_are_made_once(spark):
    regions = boxes(spark).select("page_id", F.col("block_id").alias("region_id"), "x", "y", "w",
                                  "h", F.lit("text_free").alias("label"))
    labelled = jo.inherit_label(boxes(spark), regions)
    assert made(labelled) == 1 and {r.cls for r in labelled.collect()} == {1}
    cleaned = bl.clean_labels(boxes(spark), regions, sizes(spark))
    assert made(cleaned) == 0 and cleaned.count() == 6


def test_cleaned_blocks_are_made_once(spark, monkeypatch):
    seen = []

    def merge(blocks):
        seen.append(made(blocks))
        return blocks

    monkeypatch.setattr(bl, "merge_lines_horizontal", merge)
    pl.clean_pages(boxes(spark), sizes(spark))
    assert seen == [0]


def test_near_readings_need_no_table_of_edits(monkeypatch):
    def fail(*_):
        raise AssertionError("the places in which the texts differ decide")

    monkeypatch.setattr(bl, "edits_of", fail)
    assert bl._same_reading({"_norm": "some tent here"}, {"_norm": "somc tcnt hcrc"})


def test_few_boxes_give_the_same_leaders_with_and_without_cells(monkeypatch):
    rows = [{"x": k % 5 * 4, "y": k % 7 * 3, "w": 10, "h": 6, "_norm": "ab"} for k in range(14)]

    def same(a, b):
        return bl.bx.overlap_of(a, b) > 0.40

    direct = bl._leaders(rows, same)
    monkeypatch.setattr(bl, "FEW", 0)
    assert direct == bl._leaders(rows, same) and len(set(direct)) > 1


def test_a_stamp_is_found_after_a_word_of_any_length(spark):
    texts = ["manga_com", "x net", "word org.", "9 com", "a comma", "LECTOR XYZ", "com"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(bl.is_watermark(F.col("t"))).collect()] == [
        True, True, True, False, False, True, False]
