"""Joins of boxes, texts and runs."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockflow.functions import boxes as bx
from blockflow.operators.cells import CELL, corner, meetings, on_cells
from blockflow.session import checkpointed


def overlap_join(a: DataFrame, b: DataFrame, min_ratio: float = 0.40, extra: Column | None = None,
                 cell: int = CELL) -> DataFrame:
    """Pairs on one page whose overlap ratio is above ``min_ratio``.

    ``a`` has columns ``a_x a_y a_w a_h``, ``b`` has ``b_...``; both have ``page_id``. The join
    key is (page, grid cell of a level), so one huge page spreads over its cells and a huge box has
    no more cells than a small one; a pair that meets in several cells is kept only in the cell
    that holds the corner of its intersection.
    """
    boxes_a, boxes_b = bx.box("a_"), bx.box("b_")
    meets = (corner(boxes_a, boxes_b, F.col("_level"), cell)
             & (boxes_a[0] < boxes_b[0] + boxes_b[2]) & (boxes_b[0] < boxes_a[0] + boxes_a[2])
             & (boxes_a[1] < boxes_b[1] + boxes_b[3]) & (boxes_b[1] < boxes_a[1] + boxes_a[3]))
    if extra is not None:
        meets = meets & extra
    on = on_cells(["page_id"])
    found = reduce(DataFrame.unionByName, [
        left.join(right, on).where(meets).drop(*on[1:])
        .withColumn("ratio", bx.overlap_ratio(boxes_a, boxes_b))
        for left, right in meetings(a, b, ["page_id"], cell)])
    return found.where(F.col("ratio") > min_ratio)


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def covered(boxes: DataFrame, by: DataFrame, name: str, ratio: float,
            cell: int = CELL) -> DataFrame:
    """(page_id, ``name``) of the boxes that some box of ``by`` covers by more than ``ratio``.

    A ``left_semi`` join on (page, cell): the pairs themselves are never produced. A box in several
    cells is covered if it is in any of them.
    """
    a = prefixed(boxes.select("page_id", name, "x", "y", "w", "h"), "a_")
    b = prefixed(by.select("page_id", "x", "y", "w", "h"), "b_")
    cover = bx.overlap_ratio(bx.box("a_"), bx.box("b_")) > ratio

    def semi(left: DataFrame, right: DataFrame) -> DataFrame:
        same = reduce(and_, [left[c] == right[c] for c in on_cells(["page_id"])])
        return left.join(right, same & cover, "left_semi")

    return reduce(DataFrame.union, [
        semi(left, right).select("page_id", F.col(f"a_{name}").alias(name))
        for left, right in meetings(a, b, ["page_id"], cell)]).distinct()


def uncovered(regions: DataFrame, blocks: DataFrame, ratio: float = 0.50,
              cell: int = CELL) -> DataFrame:
    """Regions that no block of the page covers by more than ``ratio``."""
    return regions.join(covered(regions, blocks, "region_id", ratio, cell),
                        ["page_id", "region_id"], "left_anti")


def inherit_label(blocks: DataFrame, regions: DataFrame, min_ratio: float = 0.30) -> DataFrame:
    """Class of each block: from the region it overlaps most, else from its own type.

    0 is text in a bubble, 1 is free text. The best region comes from one ``max_by`` with
    partial aggregation; ties go to the lower region id. The bare boxes are written once, because
    their levels are looked at before they are joined.
    """
    boxes = checkpointed(blocks.select("page_id", "block_id", "x", "y", "w", "h"))
    labelled = checkpointed(regions.select("page_id", "region_id", "label", "x", "y", "w", "h"))
    pairs = overlap_join(prefixed(boxes, "a_"), prefixed(labelled, "b_"), min_ratio)
    best = (pairs.groupBy("page_id", F.col("a_block_id").alias("block_id"))
            .agg(F.max_by("b_label", F.struct("ratio", -F.col("b_region_id"))).alias("_label")))
    own = F.lower(F.coalesce(F.col("type"), F.lit("text"))).isin("title", "header")
    return (blocks.join(best, ["page_id", "block_id"], "left")
            .withColumn("cls", F.when(F.col("_label").isNotNull(),
                                      F.lower("_label").contains("free")).otherwise(own)
                        .cast("int")).drop("_label"))


def assign_to_bands(lines: DataFrame, bands: DataFrame, cell: int = CELL) -> DataFrame:
    """Give each line (strip_id, x, y, w, h) to the band (strip_id, item_id, top, height) that
    holds its centre; lines between bands are dropped, y becomes relative to the band.

    Both sides meet on (strip, vertical cell), so a line is compared with the few bands of its
    own cell and never with all bands of a long strip.
    """
    centre = F.floor(F.col("y") + F.col("h") / 2)
    first = F.floor(F.col("top") / cell)
    spread = bands.withColumn("_cell", F.explode(F.sequence(first, F.greatest(
        first, F.ceil((F.col("top") + F.col("height")) / cell) - 1))))
    placed = lines.withColumn("_cy", centre).withColumn("_cell", F.floor(F.col("_cy") / cell))
    return (placed.join(spread, ["strip_id", "_cell"])
            .where((F.col("top") <= F.col("_cy")) & (F.col("_cy") < F.col("top") + F.col("height")))
            .withColumn("y", F.col("y") - F.col("top")).drop("_cy", "_cell"))
