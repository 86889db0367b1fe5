"""Runs over pages: status, totals, comparison, trials, latency, batches, retries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockflow.functions import text as tx
from blockflow.operators import scan
from blockflow.session import checkpointed

STATS = ["total_blocks_found", "total_blocks_translated", "pages_with_text", "pages_translated",
         "pages_empty", "pages_error"]


def cents(c: Column) -> Column:
    """Seconds as whole hundredths: sums do not depend on the order of rows."""
    return F.round(c * 100).cast("bigint")


def is_failed(status: Column) -> Column:
    return status.isin("timeout", "render_error", "conn_error") | status.startswith("http")


def page_status(pages: DataFrame) -> DataFrame:
    """Status of each page (n_blocks, n_translated, attempt, optional error)."""
    base = (F.when((F.col("n_translated") == F.col("n_blocks")) & (F.col("n_blocks") > 0), "OK")
            .when(F.col("n_translated") > 0, "PARCIAL").when(F.col("n_blocks") > 0, "SIN_TRAD")
            .otherwise("VACIO"))
    retried = F.when(F.col("attempt") > 0, F.concat(base, F.lit("_R"), F.col("attempt").cast(
        "string"))).otherwise(base)
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    return pages.withColumn("status", F.coalesce(error, retried))


def run_stats(pages: DataFrame, *keys: str) -> DataFrame:
    """Totals per run from page rows with ``status``; one combined aggregation."""
    failed = is_failed(F.col("status"))
    read = ~failed & (F.col("n_blocks") > 0)
    return (pages.groupBy(*keys).agg(
        F.sum(F.when(~failed, F.col("n_blocks")).otherwise(0)).alias("total_blocks_found"),
        F.sum(F.when(~failed, F.col("n_translated")).otherwise(0))
        .alias("total_blocks_translated"),
        F.count_if(read).alias("pages_with_text"),
        F.count_if(read & (F.col("n_translated") > 0)).alias("pages_translated"),
        F.count_if(~failed & (F.col("n_blocks") == 0)).alias("pages_empty"),
        F.count_if(failed).alias("pages_error"))
        .withColumn("translation_rate", F.col("total_blocks_translated") * 100.0
                    / F.greatest(F.col("total_blocks_found"), F.lit(1))))


def pending(pages: DataFrame, done: DataFrame, saved_total: DataFrame) -> DataFrame:
    """Pages (doc_id, page) still to do.

    Saved progress of a document (``saved_total``: doc_id, total_pages) only counts while its
    page total still matches.
    """
    now = pages.groupBy("doc_id").agg(F.count("*").alias("_now"))
    valid = (saved_total.join(now, "doc_id").where(F.col("_now") == F.col("total_pages"))
             .select("doc_id"))
    return pages.join(done.join(valid, "doc_id", "left_semi").select("doc_id", "page").distinct(),
                      ["doc_id", "page"], "left_anti")


def latest_attempt(attempts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last attempt per key and how many there were, by ``max_by`` with map-side combine."""
    rest = [c for c in attempts.columns if c not in keys]
    return (attempts.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.count("*").alias("attempts"))
        .select(*keys, "_r.*", "attempts"))


def failed_pages(pages: DataFrame) -> DataFrame:
    return pages.where(is_failed(F.col("status")))


def silent_failures(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Texts that came back unchanged, are no effects, and whose page did not fail."""
    src, tgt = tx.strip(F.coalesce("src", F.lit(""))), tx.strip(F.coalesce("tgt", F.lit("")))
    return (pairs.where((src != "") & (src == tgt) & ~tx.is_effect_repair(src))
            .join(failed_pages(pages).select("page_id").distinct(), "page_id", "left_anti"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pages of two runs (page, n_blocks, n_translated, status) that differ, and how."""
    x = a.select("page", *[F.col(c).alias("a_" + c) for c in
                           ("n_blocks", "n_translated", "status")], F.lit(True).alias("_a"))
    y = b.select("page", *[F.col(c).alias("b_" + c) for c in
                           ("n_blocks", "n_translated", "status")], F.lit(True).alias("_b"))
    same = ((F.col("a_n_blocks").eqNullSafe(F.col("b_n_blocks")))
            & (F.col("a_n_translated").eqNullSafe(F.col("b_n_translated")))
            & (F.col("a_status").eqNullSafe(F.col("b_status"))))
    change = (F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b")
              .when(~same, "changed"))
    return (x.join(y, "page", "full_outer").withColumn("change", change)
            .where(F.col("change").isNotNull()).drop("_a", "_b"))


def changed_texts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per page, positions at which the texts (page, pos, src, tgt) of two runs differ.

    Joined position by position, so no page is gathered to be compared.
    """
    x = a.select("page", "pos", F.struct("src", "tgt").alias("_a"))
    y = b.select("page", "pos", F.struct("src", "tgt").alias("_b"))
    return (x.join(y, ["page", "pos"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
            .groupBy("page").agg(F.count("*").alias("changed_texts")))


def metric_deltas(stats: DataFrame, first, second, key: str = "run") -> DataFrame:
    """One row per metric: both runs, difference, and the rate difference in points."""
    long = stats.select(key, F.explode(F.create_map(*[
        x for c in STATS for x in (F.lit(c), F.col(c).cast("double"))],
        F.lit("translation_rate"), F.col("translation_rate"))).alias("metric", "value"))
    return (long.groupBy("metric")
            .agg(F.max(F.when(F.col(key) == first, F.col("value"))).alias("a"),
                 F.max(F.when(F.col(key) == second, F.col("value"))).alias("b"))
            .withColumn("delta", F.col("b") - F.col("a")))


def median_repetition(records: DataFrame) -> DataFrame:
    """Of the repetitions of each (page, arm), the one with the middle time."""
    w = Window.partitionBy("page", "arm")
    ranked = (records.withColumn("_n", F.count("*").over(w))
              .withColumn("_k", F.row_number().over(w.orderBy("total_s", "rep"))))
    return ranked.where(F.col("_k") == F.floor(F.col("_n") / 2) + 1).drop("_n", "_k")


def ab_effect(records: DataFrame, stage: str = "stage_s") -> DataFrame:
    """Verdict of a trial (page, arm base/alt, rep, total_s, n_blocks, stage seconds).

    Pages whose base run did not use the stage are controls: their drift is the noise against
    which the effect on the other pages is read.
    """
    mid = median_repetition(records)
    per_page = mid.groupBy("page").agg(
        *[F.max(F.when(F.col("arm") == arm, c)).alias(f"{arm}_{n}")
          for arm in ("base", "alt") for n, c in (
              ("cs", cents(F.col("total_s"))), ("blocks", F.col("n_blocks")),
              ("stage", F.col(stage)))]).where(
        F.col("base_cs").isNotNull() & F.col("alt_cs").isNotNull())
    delta = F.col("alt_cs") - F.col("base_cs")
    control, used = F.col("base_stage") == 0, F.col("base_stage") > 0
    t = per_page.agg(
        F.count("*").alias("pages"), F.count_if(control).alias("controls"),
        F.count_if(used).alias("affected"),
        (F.sum(F.when(control, delta)) / F.count_if(control) / 100).alias("drift_mean"),
        (F.max(F.when(control, F.abs(delta))) / 100).alias("drift_max"),
        (F.sum(F.when(used, delta)) / F.count_if(used) / 100).alias("effect"),
        (F.sum("base_cs") / F.count("*") / 100).alias("avg_base"),
        (F.sum("alt_cs") / F.count("*") / 100).alias("avg_alt"),
        F.sum("base_blocks").alias("blocks_base"), F.sum("alt_blocks").alias("blocks_alt"))
    t = t.na.fill(0.0, ["drift_mean", "drift_max", "effect"])
    limit = F.greatest(F.lit(0.10), F.col("avg_base") * 0.04)
    steady = (F.abs("drift_mean") <= limit) & (F.col("drift_max") <= limit)
    return t.withColumn("verdict", F.when(F.col("controls") == 0, "no_controls")
                        .when(steady, "stable")
                        .when(F.abs("effect") > F.col("drift_max"), "cautious")
                        .otherwise("inconclusive"))


def latency_report(pages: DataFrame, limit_s: float = 200.0, *keys: str) -> DataFrame:
    """Success, errors and the spread of times (elapsed_s, ok), by optional keys.

    Times are rounded to hundredths first: the exact percentile keeps one counter per distinct
    value, which bounds its memory by the range of times and not by the number of pages.
    """
    ok, t = F.col("ok"), F.round(F.col("elapsed_s"), 2)
    good = F.when(ok, t)
    parts = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90}
    return pages.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("errors"),
        F.round(F.sum(F.when(ok, cents(F.col("elapsed_s")))) / F.count_if(ok) / 100, 6)
        .alias("mean"),
        F.min(good).alias("min"),
        *[F.round(F.percentile(good, p), 6).alias(n) for n, p in parts.items()],
        F.max(good).alias("max"), F.count_if(ok & (t > limit_s)).alias("over_limit"))


def latency_histogram(pages: DataFrame, width: int = 25) -> DataFrame:
    return (pages.groupBy((F.floor(F.col("elapsed_s") / width) * width).alias("bucket"))
            .agg(F.count("*").alias("n")))


def memory_growth(samples: DataFrame, limit_mb: float = 100.0) -> DataFrame:
    """Growth between the first and last sample (ts, rss_mb, ok) and the leak flag."""
    return (samples.agg(F.min_by("rss_mb", "ts").alias("before"),
                        F.max_by("rss_mb", "ts").alias("after"),
                        F.count_if(~F.col("ok")).alias("errors"))
            .withColumn("growth", F.col("after") - F.col("before"))
            .withColumn("leak", (F.col("errors") > 0) | (F.col("growth") > limit_mb)))


def production_summary(pages: DataFrame) -> DataFrame:
    """One row over page benchmark records: means, trigger, call and recovery counts."""
    skipped = F.col("trigger") & (F.col("aggressive_calls") == 0) & ~F.col("vlm_called")
    return pages.agg(
        F.count("*").alias("pages"),
        (F.sum(cents(F.col("total_s"))) / 100).alias("total_s"),
        (F.sum(cents(F.col("total_s"))) / F.count("*") / 100).alias("avg_s"),
        F.sum("n_blocks").alias("blocks"), F.count_if("trigger").alias("triggers"),
        F.count_if("vlm_called").alias("vlm_calls"), F.sum("vlm_recovered").alias("recovered"),
        F.count_if("salvaged").alias("salvaged"), F.count_if(skipped).alias("negative_skips"),
        *[F.count_if(F.coalesce(F.try_element_at("calls", F.lit(k)), F.lit(0)) > 0)
          .alias(k + "_pages") for k in ("yolo", "ctd")])


def stage_seconds(pages: DataFrame) -> DataFrame:
    """Seconds by stage out of the stage maps."""
    return (pages.select(F.explode("stages").alias("stage", "seconds")).groupBy("stage")
            .agg((F.sum(cents(F.col("seconds"))) / 100).alias("seconds"),
                 F.count("*").alias("pages")))


def stage_share(pages: DataFrame) -> DataFrame:
    """Share of each stage and whether it dominates (> 60 %) or does not matter (< 40 %).

    The total joins from the aggregated stages: a handful of rows.
    """
    by_stage = stage_seconds(pages)
    total = by_stage.agg(F.sum(cents(F.col("seconds"))).alias("_total"))
    share = cents(F.col("seconds")) * 100.0 / F.col("_total")
    return (by_stage.join(F.broadcast(total)).withColumn("share_pct", share)
            .withColumn("role", F.when(F.col("share_pct") > 60, "dominates")
                        .when(F.col("share_pct") < 40, "minor").otherwise("balanced"))
            .drop("_total"))


def mode_summary(pages: DataFrame) -> DataFrame:
    """Per mode (mode, elapsed_s, n_blocks, error): seconds, blocks, errors."""
    return pages.groupBy("mode").agg(
        F.count("*").alias("pages"),
        (F.sum(cents(F.col("elapsed_s"))) / 100).alias("total_s"),
        (F.sum(cents(F.col("elapsed_s"))) / F.count("*") / 100).alias("mean_s"),
        F.sum("n_blocks").alias("blocks"),
        (F.sum("n_blocks") / F.count("*")).alias("mean_blocks"),
        F.count_if("error").alias("errors"))


def with_and_without(pages: DataFrame) -> DataFrame:
    """The same pages with and without a step (page, step BOOLEAN, n_blocks, elapsed_s)."""
    agg = pages.groupBy("page").agg(
        F.sum(F.when(F.col("step"), F.col("n_blocks"))).alias("blocks_with"),
        F.sum(F.when(~F.col("step"), F.col("n_blocks"))).alias("blocks_without"),
        (F.sum(F.when(F.col("step"), cents(F.col("elapsed_s")))) / 100).alias("seconds_with"),
        (F.sum(F.when(~F.col("step"), cents(F.col("elapsed_s")))) / 100).alias("seconds_without"))
    return agg.where(F.col("blocks_with").isNotNull() & F.col("blocks_without").isNotNull())


def metric_gate(current: DataFrame, thresholds: DataFrame, base: DataFrame, scope: DataFrame,
                slack: float = 0.05) -> DataFrame:
    """Verdict per metric (name, value): below its threshold fails inside the scope and warns
    outside; a metric in scope without threshold fails; plus the change to a base snapshot."""
    in_scope = scope.select("name").distinct().withColumn("_in", F.lit(True))
    j = (current.join(thresholds.select("name", "threshold"), "name", "left")
         .join(base.select("name", F.col("value").alias("base_value")), "name", "left")
         .join(in_scope, "name", "left").withColumn("in_scope", F.coalesce("_in", F.lit(False))))
    low = F.col("value") < F.col("threshold") - slack
    verdict = (F.when(F.col("threshold").isNull(), F.when(F.col("in_scope"), "FAIL")
                      .otherwise("SKIP"))
               .when(low & F.col("in_scope"), "FAIL").when(low, "WARN").otherwise("OK"))
    return (j.withColumn("verdict", verdict).withColumn(
        "delta", F.col("value") - F.col("base_value")).drop("_in"))


def round_history(rounds: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """Step-by-step and overall change of a score over rounds (one row per round)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (rounds.withColumn("step", F.col(score) - F.lag(score).over(w))
            .withColumn("since_first", F.col(score) - F.first(score).over(w)))


def append_round(rounds: DataFrame, path: str) -> None:
    rounds.write.mode("append").parquet(path)


def share_batch_time(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Batch seconds split evenly over its pages; missing or bad results become rows.

    ``requests`` (batch_id, page), ``results`` (batch_id, page, ok, elapsed).
    """
    size = requests.groupBy("batch_id").agg(F.count("*").alias("_n"))
    elapsed = results.groupBy("batch_id").agg(F.max("batch_elapsed_s").alias("_s"))
    got = results.select("batch_id", "page", "ok")
    return (requests.join(size, "batch_id").join(elapsed, "batch_id", "left")
            .join(got, ["batch_id", "page"], "left")
            .withColumn("elapsed_s", F.col("_s") / F.col("_n"))
            .withColumn("status", F.when(F.col("ok").isNull(), "missing_result")
                        .when(F.col("ok"), "done").otherwise("bad_result"))
            .drop("_n", "_s", "ok"))


def make_batches(rows: DataFrame, keys: list[str], order: str, size: int,
                 width: int = 1 << 16) -> DataFrame:
    """Consecutive batches of at most ``size`` rows per key, in the order of a number column.

    The rank is built bucket by bucket, so one long document does not pass through one task.
    """
    ranked = scan.rank(rows.withColumn("_b", F.floor(F.col(order) / width)), keys, [order], "_b",
                       "_rank")
    return (ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size))
            .drop("_b", "_rank"))


def sample_pages(catalog: DataFrame, used: DataFrame, n: int,
                 skip_edges: int = 2) -> DataFrame:
    """Up to ``n`` evenly spaced pages per series (series, chapter, page).

    Copies of a series ("Name (1)") and chapters in ``used`` (series, chapter) are left out, as
    are the first and last pages of chapters with more than four; chapters are taken in order
    until they hold 2 n pages. Positions are worked out from counts per chapter, which are few.
    """
    fresh = (catalog.where(~F.col("series").rlike(r"\(\d+\)$"))
             .join(used.select("series", "chapter").distinct(), ["series", "chapter"],
                   "left_anti"))
    in_chapter = Window.partitionBy("series", "chapter").orderBy("page")
    sizes = fresh.groupBy("series", "chapter").agg(F.count("*").alias("_size"))
    sizes = (sizes.withColumn("_skip", F.when(F.col("_size") > 4, skip_edges).otherwise(0))
             .withColumn("_body", F.col("_size") - F.col("_skip") * 2))
    before = (Window.partitionBy("series").orderBy("chapter")
              .rowsBetween(Window.unboundedPreceding, -1))
    sizes = (sizes.withColumn("_before", F.coalesce(F.sum("_body").over(before), F.lit(0)))
             .where(F.col("_before") < 2 * n))
    total = sizes.groupBy("series").agg(F.sum("_body").alias("_c"))
    last = F.least(F.lit(n), F.col("_c"))
    picks = (total.where(F.col("_c") > 0)
             .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), last - 1)))
             .withColumn("_at", F.when(last > 1, F.bround(
                 F.col("_i") * (F.col("_c") - 1) / (last - 1), 0).cast("bigint")).otherwise(0))
             .select("series", "_at").distinct())
    placed = (fresh.withColumn("_k", F.row_number().over(in_chapter))
              .join(sizes, ["series", "chapter"])
              .where((F.col("_k") > F.col("_skip")) & (F.col("_k") <= F.col("_size") - F.col("_skip")))
              .withColumn("_at", F.col("_before") + F.col("_k") - F.col("_skip") - 1))
    return placed.join(picks, ["series", "_at"], "left_semi").select("series", "chapter", "page")


def training_set(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Base train and extra rows for training; validation only from the base."""
    return base.select("page_id", "split").unionByName(
        extra.select("page_id").withColumn("split", F.lit("train")))


def split_check(data: DataFrame, wanted: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Rows per wanted split and whether it may be used."""
    spark = data.sparkSession
    need = spark.createDataFrame([(s,) for s in wanted], "split string")
    counts = data.groupBy("split").agg(F.count("*").alias("n"))
    return (need.join(counts, "split", "left").na.fill(0, ["n"])
            .withColumn("ok", F.col("n") > 0))


def text_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct texts only in one run, only in the other, or in both, counted per page."""
    m = (a.select("page_id", "text", F.lit(1).alias("s"))
         .unionByName(b.select("page_id", "text", F.lit(2).alias("s")))
         .groupBy("page_id", "text").agg(F.bit_or("s").alias("s")))
    return m.groupBy("page_id").agg(F.count_if(F.col("s") == 1).alias("only_base"),
                                    F.count_if(F.col("s") == 2).alias("only_alt"),
                                    F.count_if(F.col("s") == 3).alias("both"))


def compact_ranges(ids: DataFrame, key: str, number: str, width: int = 1 << 16) -> DataFrame:
    """Runs of consecutive numbers per key as (first, last) rows.

    A number that follows its predecessor continues a range; the look back crosses buckets.
    """
    d = ids.select(key, number).distinct().withColumn("_b", F.floor(F.col(number) / width))
    d = checkpointed(scan.previous(d, [key], [number], "_b", F.col(number), "_prev"))
    new = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(number) - 1), F.col(number))
    d = scan.latest(d, [key], [number], "_b", new, "first")
    return d.groupBy(key, "first").agg(F.max(number).alias("last"))


def range_text(ranges: DataFrame, key: str) -> DataFrame:
    """All ranges of a key as one line, such as ``1-4, 7``."""
    item = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(
        F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    items = F.array_sort(F.collect_list(F.struct("first", item.alias("t"))))
    return ranges.groupBy(key).agg(F.array_join(F.transform(items, lambda r: r["t"]), ", ")
                                   .alias("ranges"))
