"""Service logs: categories, typed events, context."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockflow.rules import patterns as pt


def category(line: Column) -> Column:
    """First matching category, or null."""
    out = None
    for name, pattern in pt.LOG_CATEGORIES:
        out = F.when(line.rlike(pattern), name) if out is None else out.when(
            line.rlike(pattern), name)
    return out


def last_seen_text(lines: DataFrame, back: int = 30, span: int = 4096) -> DataFrame:
    """``context``: the most recent ``text='…'`` in the ``back`` lines before (file, line_no).

    A long file is cut into spans of lines; each span also gets the ``back`` lines before it,
    so no window holds more than a span.
    """
    text = F.nullif(F.regexp_extract("line", pt.LOG_TEXT, 1), F.lit(""))
    own = F.floor(F.col("line_no") / span)
    ahead = F.floor((F.col("line_no") + back) / span)
    spread = lines.withColumn("_text", text).withColumn("_own", own).withColumn(
        "_span", F.explode(F.when(ahead > own, F.array(own, ahead)).otherwise(F.array(own))))
    w = (Window.partitionBy("file", "_span").orderBy("line_no").rowsBetween(-back, -1))
    return (spread.withColumn("context", F.last("_text", ignorenulls=True).over(w))
            .where(F.col("_span") == F.col("_own")).drop("_text", "_own", "_span"))


def classify_log(lines: DataFrame) -> DataFrame:
    """Lines with their ``category``; lines without one are dropped."""
    return lines.withColumn("category", category(F.col("line"))).where(
        F.col("category").isNotNull())


def log_summary(lines: DataFrame) -> DataFrame:
    """Count, share of all lines, and files per category; an extra row counts lost blocks."""
    marked = lines.withColumn("category", F.coalesce(category(F.col("line")), F.lit("OTHER")))
    per = marked.groupBy("category").agg(F.count("*").alias("n"),
                                         F.count_distinct("file").alias("files"))
    total = per.agg(F.sum("n").alias("_t"), F.sum(F.when(F.col("category").isin(
        pt.LOST_CATEGORIES), F.col("n")).otherwise(0)).alias("lost_blocks"))
    return (per.where("category <> 'OTHER'").join(F.broadcast(total))
            .withColumn("share_pct", F.col("n") * 100.0 / F.col("_t")).drop("_t"))


def top_contexts(classified: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` most frequent contexts per category (category, context)."""
    counts = (classified.where(F.col("context").isNotNull()).groupBy("category", "context")
              .agg(F.count("*").alias("n")))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "context")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def log_samples(classified: DataFrame, k: int = 5, shards: int = 64) -> DataFrame:
    """The first ``k`` lines per category, cut inside shards before the final rank."""
    order = ["file", "line_no"]
    part = Window.partitionBy("category", "_s").orderBy(*order)
    first = (classified.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(shards)))
             .withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= k))
    final = Window.partitionBy("category").orderBy(*order)
    return (first.withColumn("_k", F.row_number().over(final)).where(F.col("_k") <= k)
            .drop("_k", "_s"))


def log_metrics(lines: DataFrame) -> DataFrame:
    """Typed events with the numbers they carry: (…, kind, numbers map)."""
    kind, numbers = None, None
    line = F.col("line")
    for name, pattern, fields in pt.LOG_EVENTS:
        hit = line.rlike(pattern)
        values = (F.create_map(*[x for n, f in enumerate(fields, 1) for x in (
            F.lit(f), F.regexp_extract(line, pattern, n).try_cast("double"))])
            if fields else F.create_map().cast("map<string,double>"))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        numbers = F.when(hit, values) if numbers is None else numbers.when(hit, values)
    return (lines.withColumn("kind", kind).where(F.col("kind").isNotNull())
            .withColumn("numbers", numbers))


def log_event_counts(events: DataFrame) -> DataFrame:
    """Events and the sum of each number, by kind."""
    counts = events.groupBy("kind").agg(F.count("*").alias("n"))
    sums = (events.select("kind", F.explode("numbers").alias("field", "value"))
            .groupBy("kind", "field").agg(F.sum(F.round(F.col("value") * 1000).cast("bigint"))
                                          .alias("milli")))
    return counts.join(sums, "kind", "left")
