"""Ordered scans over keys that may be very large.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task. Here a key is
cut into buckets of its order; a window runs inside each (key, bucket), and what earlier
buckets add up to comes from a small table with one row per bucket. No step ever holds more
than one bucket of one key. A scan reads its input twice, once for the totals; where one scan
feeds another, the first is written once, so chains do not multiply the reads.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NONE = "_everything"


def _keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn(_NONE, F.lit(0)), [_NONE])


def _earlier(totals: DataFrame, keys: list[str], bucket: str, combine, name: str) -> DataFrame:
    """Per bucket, what all earlier buckets of the key add up to."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, combine(F.col(name)).over(before))


def totals_before(df: DataFrame, keys: list[str], bucket: str, total: Column,
                  name: str) -> DataFrame:
    """One row per bucket of a key: ``name`` is the total over the key's earlier buckets, or 0."""
    totals = df.groupBy(*keys, bucket).agg(total.alias(name))
    return _earlier(totals, keys, bucket, F.sum, name).withColumn(
        name, F.coalesce(name, F.lit(0)))


def running_total(df: DataFrame, keys: list[str], order: list[str], bucket: str,
                  value: Column, name: str) -> DataFrame:
    """Add ``name``: sum of ``value`` over the rows of the key up to and including this one."""
    df, ks = _keys(df.withColumn("_v", value), keys)
    inside = (Window.partitionBy(*ks, bucket).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    offsets = _earlier(df.groupBy(*ks, bucket).agg(F.sum("_v").alias("_off")), ks, bucket, F.sum,
                       "_off")
    out = (df.withColumn(name, F.sum("_v").over(inside)).join(offsets, [*ks, bucket])
           .withColumn(name, F.col(name) + F.coalesce("_off", F.lit(0))))
    return out.drop("_v", "_off", _NONE)


def rank(df: DataFrame, keys: list[str], order: list[str], bucket: str, name: str) -> DataFrame:
    """Add ``name``: 1 for the first row of the key, 2 for the next, and so on."""
    return running_total(df, keys, order, bucket, F.lit(1).cast("bigint"), name)


def earlier_max(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column,
                name: str) -> DataFrame:
    """Add ``name``: the largest ``value`` among earlier rows of the key, null for the first."""
    df, ks = _keys(df.withColumn("_v", value), keys)
    inside = (Window.partitionBy(*ks, bucket).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = _earlier(df.groupBy(*ks, bucket).agg(F.max("_v").alias("_off")), ks, bucket, F.max,
                       "_off")
    out = (df.withColumn(name, F.max("_v").over(inside)).join(offsets, [*ks, bucket])
           .withColumn(name, F.greatest(F.col(name), F.col("_off"))))
    return out.drop("_v", "_off", _NONE)


def latest(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column,
           name: str) -> DataFrame:
    """Add ``name``: the last non-null ``value`` among the rows of the key up to this one.

    Rows equal in ``order`` see each other, so ties cannot make the answer depend on their
    physical order.
    """
    df, ks = _keys(df.withColumn("_v", value), keys)
    inside = (Window.partitionBy(*ks, bucket).orderBy(*order)
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ends = df.groupBy(*ks, bucket).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_off"))
    offsets = _earlier(ends, ks, bucket, lambda c: F.last(c, ignorenulls=True), "_off")
    out = (df.withColumn(name, F.last("_v", ignorenulls=True).over(inside))
           .join(offsets, [*ks, bucket]).withColumn(name, F.coalesce(F.col(name), F.col("_off"))))
    return out.drop("_v", "_off", _NONE)


def previous(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column,
             name: str) -> DataFrame:
    """Add ``name``: ``value`` (never null) of the row before, across bucket borders."""
    df, ks = _keys(df.withColumn("_v", value), keys)
    inside = Window.partitionBy(*ks, bucket).orderBy(*order)
    ends = df.groupBy(*ks, bucket).agg(F.max_by("_v", F.struct(*order)).alias("_off"))
    offsets = ends.withColumn("_off", F.lag("_off").over(Window.partitionBy(*ks).orderBy(bucket)))
    out = (df.withColumn(name, F.lag("_v").over(inside)).join(offsets, [*ks, bucket])
           .withColumn(name, F.coalesce(F.col(name), F.col("_off"))))
    return out.drop("_v", "_off", _NONE)


def strips(df: DataFrame, keys: list[str], top: Column, bottom: Column, tile: int,
           name: str = "strip") -> DataFrame:
    """Add ``name``: rows of a key whose [top, bottom] intervals touch share a strip.

    A strip is named by its first top. Work that only relates boxes whose intervals touch can
    run per (key, strip) instead of per key, with the same result.

    Inside a tile, a row starts a strip when its top lies beyond everything before it. A tile
    is summed up by how far it reaches and where its last strip starts; from these, each tile
    learns how far earlier tiles reach into it and which strip they leave open.
    """
    df = (df.withColumn("_top", top.cast("double")).withColumn("_bottom", bottom.cast("double"))
          .withColumn("_tile", F.floor(F.col("_top") / tile)))
    part = Window.partitionBy(*keys, "_tile").orderBy("_top", "_bottom")
    before = F.max("_bottom").over(part.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_reach", before).withColumn("_start", F.when(
        F.col("_reach").isNull() | (F.col("_top") > F.col("_reach")), F.col("_top")))
    along = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = (df.groupBy(*keys, "_tile").agg(F.max("_bottom").alias("_m"),
                                            F.max("_start").alias("_l"))
             .withColumn("_in", F.max("_m").over(along))
             .withColumn("_l", F.when(F.col("_in").isNull() | (F.col("_l") > F.col("_in")),
                                      F.col("_l")))
             .withColumn("_open", F.last("_l", ignorenulls=True).over(along))
             .select(*keys, "_tile", "_in", "_open"))
    own = F.when(F.col("_in").isNull() | (F.col("_start") > F.col("_in")), F.col("_start"))
    here = part.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal rows agree
    return (df.join(tiles, [*keys, "_tile"]).withColumn("_own", own)
            .withColumn(name, F.coalesce(F.last("_own", ignorenulls=True).over(here), "_open"))
            .drop("_top", "_bottom", "_tile", "_reach", "_start", "_in", "_open", "_own"))


def strip_sums(df: DataFrame, keys: list[str], top: Column, bottom: Column, tile: int,
               **sums: Column) -> DataFrame:
    """One row per (keys, _tile, strip) with ``sums`` over its rows, for ``near_strips``.

    Only what ``top``, ``bottom`` and ``sums`` look at is shuffled, so the rows may be wide.
    """
    bare = df.select(*keys, top.cast("double").alias("_a"), bottom.cast("double").alias("_b"),
                     *[c.alias(name) for name, c in sums.items()])
    cut = strips(bare, keys, F.col("_a"), F.col("_b"), tile).withColumn(
        "_tile", F.floor(F.col("_a") / tile))
    return cut.groupBy(*keys, "_tile", "strip").agg(
        F.count("*").alias("n"), *[f(name).alias(f"{f.__name__}_{name}")
                                   for name in sums for f in (F.min, F.max)])


def crossings(sums: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Tiles into which a strip of an earlier tile reaches: where that began (``_open``), and where
    the first strip of the tile's own begins (``_own``)."""
    home = F.floor(F.col("strip") / tile)
    return (sums.groupBy(*keys, "_tile").agg(
        F.max(F.when(home < F.col("_tile"), F.col("strip"))).alias("_open"),
        F.min(F.when(home == F.col("_tile"), F.col("strip"))).alias("_own"))
        .where(F.col("_open").isNotNull()))


def near_strips(df: DataFrame, keys: list[str], top: Column, bottom: Column, tile: int,
                crossing: DataFrame, name: str = "strip", home: str = "_home") -> DataFrame:
    """``strips`` with a single shuffle of the rows, after which each strip lies in one task.

    A strip is at home in the tile that it begins in. ``crossing`` (written; see ``crossings``) tells
    which rows are at home in an earlier tile; all rows of a key and a ``home`` go together.
    """
    df = (df.withColumn("_top", top.cast("double")).withColumn("_bottom", bottom.cast("double"))
          .where(F.col("_top").isNotNull()).withColumn("_tile", F.floor(F.col("_top") / tile)))
    if not crossing.isEmpty():
        reached = F.col("_open").isNotNull() & (F.col("_own").isNull()
                                                | (F.col("_top") < F.col("_own")))
        df = (df.join(crossing, [*keys, "_tile"], "left").withColumn("_tile", F.when(
            reached, F.floor(F.col("_open") / tile)).otherwise(F.col("_tile")))
            .drop("_open", "_own"))
    part = Window.partitionBy(*keys, home).orderBy("_top", "_bottom")
    reach = F.max("_bottom").over(part.rowsBetween(Window.unboundedPreceding, -1))
    here = part.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal rows agree
    return (df.withColumnRenamed("_tile", home).repartition(*keys, home).withColumn("_reach", reach)
            .withColumn("_start", F.when(F.col("_reach").isNull()
                                         | (F.col("_top") > F.col("_reach")), F.col("_top")))
            .withColumn(name, F.last("_start", ignorenulls=True).over(here))
            .drop("_top", "_bottom", "_reach", "_start"))
