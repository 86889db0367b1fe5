"""Grid cells by level: boxes that can touch meet on a key, whatever their size.

A level's cells are twice as wide as those of the level below, and a box lies at the level whose cells
are as wide as itself, so it touches at most four of them. Two boxes meet at the coarser of their
two levels: the smaller one is also given the cells of the coarser levels that exist on its page on
the other side. Nearly all boxes are at level 0 and have no other.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockflow.functions import boxes as bx

CELL = 512  # pixels of a cell at level 0; most boxes touch one or two
_AT = ["_level", "_gx", "_gy"]


def level(w: Column, h: Column, cell: int = CELL) -> Column:
    """The lowest level whose cells are as wide and high as the box."""
    return F.coalesce(F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(w, h) / cell))),
                      F.lit(0)).cast("int")


def touched(at: Column, x: Column, y: Column, w: Column, h: Column, cell: int = CELL) -> Column:
    """The cells of a level that a half-open box touches, as an array of (level, gx, gy)."""
    size = F.pow(F.lit(2.0), at) * cell

    def span(start: Column, length: Column) -> Column:
        first = F.floor(start / size)
        return F.sequence(first, F.greatest(first, F.ceil((start + length) / size) - 1))

    return F.flatten(F.transform(span(x, w), lambda gx: F.transform(span(y, h), lambda gy: F.struct(
        at.alias("level"), gx.alias("gx"), gy.alias("gy")))))


def corner(a, b, at: Column, cell: int = CELL) -> Column:
    """Whether the joined cell is the one that holds the corner of the intersection."""
    size = F.pow(F.lit(2.0), at) * cell
    return ((F.col("_gx") == F.floor(F.greatest(a[0], b[0]) / size))
            & (F.col("_gy") == F.floor(F.greatest(a[1], b[1]) / size)))


def _spread(df: DataFrame, prefix: str, at: Column, cell: int) -> DataFrame:
    found = df.withColumn("_cell", F.explode(touched(at, *bx.box(prefix), cell)))
    return found.select(*df.columns, *[F.col(f"_cell.{c[1:]}").alias(c) for c in _AT])


def coarsest(df: DataFrame, prefix: str, cell: int = CELL) -> int:
    """The highest level of any box; over a stored table this reads two columns."""
    return df.agg(F.max(level(F.col(prefix + "w"), F.col(prefix + "h"), cell))).first()[0] or 0


def meetings(a: DataFrame, b: DataFrame, keys: list[str], cell: int = CELL
             ) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of tables to join on ``keys`` and the cell: together they bring every two touching
    boxes of ``a`` (columns a_x ...) and ``b`` (b_x ...) together at one level, in the cells there
    that both touch. Without boxes above level 0 it is one pair."""
    def own(prefix: str) -> Column:
        return level(F.col(prefix + "w"), F.col(prefix + "h"), cell)

    def raised(df: DataFrame, prefix: str, other: DataFrame, side: str) -> DataFrame:
        """Boxes at the coarser levels that the other side has on their page."""
        coarse = other.select(*keys, own(side).alias("_coarse")).where("_coarse > 0").distinct()
        return _spread(df.join(coarse, keys).where(F.col("_coarse") > own(prefix)), prefix,
                       F.col("_coarse"), cell).drop("_coarse")

    at_a, at_b = _spread(a, "a_", own("a_"), cell), _spread(b, "b_", own("b_"), cell)
    found = [(at_a, at_b)]
    if coarsest(b, "b_", cell):
        found.append((raised(a, "a_", b, "b_"), at_b))
    if coarsest(a, "a_", cell):
        found.append((at_a, raised(b, "b_", a, "a_")))
    return found


def on_cells(keys: list[str]) -> list[str]:
    return [*keys, *_AT]
