"""Greedy choices in rounds: the best goes first, and what conflicts with a kept one is struck.

Taking boxes one by one in the order of rank is a fold over everything that hangs together. The
same result comes in rounds: a box whose better neighbours are all decided is decided too. Neighbours
meet on grid cells by level. From each cell a round takes only the best ``FIRST`` boxes, so a
pile of boxes makes no more pairs than a few; a box that is among the first in all its cells sees there
every better box that could strike it. If none of them conflicts it is kept, and every conflicting
box in its cells is struck, found by a semi join. Nothing is held in one task, and rounds are
written tables, as many as conflicts hang on each other in a row.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockflow.functions import boxes as bx
from blockflow.operators.cells import level, touched
from blockflow.session import checkpointed

FIRST = 64
Conflict = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def _celled(boxes: DataFrame, keys: list[str], cell: int, higher: int | None) -> DataFrame:
    """Boxes with the cells of their own level and of the coarser ones that boxes of their group
    have, at most ``higher`` levels up."""
    boxes = boxes.withColumn("_own", level(F.col("w"), F.col("h"), cell))
    levels = boxes.groupBy(*keys).agg(F.collect_set("_own").alias("_levels"))  # at most 22
    used = F.filter("_levels", lambda at: (at >= F.col("_own")) if higher is None else
                    (at >= F.col("_own")) & (at <= F.col("_own") + higher))
    cells = F.flatten(F.transform(used, lambda at: touched(at, *bx.box(), cell)))
    return boxes.join(levels, keys).withColumn("_cells", cells).drop("_levels")


def _in_cells(boxes: DataFrame, prefix: str, columns: list[str], keys: list[str]) -> DataFrame:
    found = boxes.withColumn("_cell", F.explode("_cells"))
    return found.select(*keys, "_cell", *[F.col(c).alias(prefix + c) for c in columns])


def keep_first(boxes: DataFrame, keys: list[str], conflict: Conflict, number: str = "_n",
               rank: str = "_rank", cell: int = 64, higher: int | None = None
               ) -> tuple[DataFrame, int]:
    """The boxes that a greedy pass over each group (``keys``) keeps, and the rounds it took.

    ``boxes`` is a written table with x, y, w, h, a ``number`` and a ``rank`` of its own each, lowest
    first. ``conflict(a, b)`` is a condition over the columns of two boxes, got as a("x"). Boxes
    of which one is more than 2 ** ``higher`` times as large may not conflict.
    """
    columns = [c for c in boxes.columns if c not in keys] + ["_own"]
    clash = conflict(lambda c: F.col("a_" + c), lambda c: F.col("b_" + c))
    better = F.col("a_" + rank) < F.col("b_" + rank)
    meet = (F.greatest("a__own", "b__own") == F.col("_cell.level"))
    left, kept = boxes, []
    while not left.isEmpty():
        celled = checkpointed(_celled(left, keys, cell, higher))
        best = Window.partitionBy(*keys, "_cell").orderBy("b_" + rank)
        top = checkpointed(_in_cells(celled, "b_", columns, keys)
                           .withColumn("_place", F.row_number().over(best))
                           .where(F.col("_place") <= FIRST))
        seen = top.groupBy(F.col("b_" + number).alias(number)).agg(F.count("*").alias("_in"))
        whole = celled.join(seen, number).where(F.col("_in") == F.size("_cells"))
        others = top.select(*keys, "_cell", *[F.col("b_" + c).alias("a_" + c) for c in columns])
        waits = (others.join(top, [*keys, "_cell"]).where(better & meet & clash)
                 .select(F.col("b_" + number).alias(number)).distinct())
        chosen = checkpointed(whole.join(waits, number, "left_anti"))
        kept.append(chosen.select(*boxes.columns))
        hit = _in_cells(celled, "b_", columns, keys)
        by = _in_cells(chosen.drop("_in"), "a_", columns, keys)
        same = reduce(lambda x, y: x & y, [by[k].eqNullSafe(hit[k]) for k in keys]
                      + [by["_cell"] == hit["_cell"]])
        struck = (hit.join(by, same & (F.greatest("a__own", "b__own") == hit["_cell.level"])
                           & better & clash, "left_semi")
                  .select(F.col("b_" + number).alias(number)).distinct())
        gone = struck.union(chosen.select(number))
        left = checkpointed(left.join(gone, number, "left_anti"))
    none = boxes.limit(0)
    return reduce(DataFrame.unionByName, kept, none), len(kept)


def followers(boxes: DataFrame, kept: DataFrame, keys: list[str], conflict: Conflict,
              number: str = "_n", rank: str = "_rank", cell: int = 64) -> DataFrame:
    """(number, leader): for each box that was not kept the best kept one that conflicts."""
    celled = checkpointed(_celled(boxes, keys, cell, None))
    columns = [c for c in boxes.columns if c not in keys] + ["_own"]
    clash = conflict(lambda c: F.col("a_" + c), lambda c: F.col("b_" + c))
    chosen = celled.join(kept.select(number), number, "left_semi")
    rest = celled.join(kept.select(number), number, "left_anti")
    pairs = _in_cells(chosen, "a_", columns, keys).join(_in_cells(rest, "b_", columns, keys),
                                                        [*keys, "_cell"])
    return (pairs.where((F.greatest("a__own", "b__own") == F.col("_cell.level"))
                        & (F.col("a_" + rank) < F.col("b_" + rank)) & clash)
            .groupBy(F.col("b_" + number).alias(number))
            .agg(F.min_by("a_" + number, "a_" + rank).alias("leader")))
