"""Per-key state over arrival order: limits, streaks, page decisions, packing.

Where a key can be very long it is cut so that the pieces run in parallel with the same result:
into chunks whose effect on every possible entry state is worked out before the chunks are put
in order.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockflow.operators import scan
from blockflow.operators.folds import fold_groups, fold_stream
from blockflow.operators.memory import seconds
from blockflow.session import checkpointed

HOUR, DAY = 3600, 86_400
LOOPBACK = ["127.0.0.1", "::1", "localhost", "::ffff:127.0.0.1"]


def rate_limit(calls: DataFrame, per_hour: int = 500, per_day: int = 2000) -> DataFrame:
    """``allowed`` per call (client, ts, event_id): fixed hour and day buckets per client.

    The number within the hour comes from a window per (client, hour); the number within the
    day adds the totals of the day's earlier hours.
    """
    t = seconds(F.col("ts"))
    c = (calls.withColumn("_hour", F.floor(t / HOUR)).withColumn("_day", F.floor(t / DAY))
         .withColumn("_minute", F.floor(t / 60)))
    c = checkpointed(scan.rank(c, ["client", "_hour"], ["ts", "event_id"], "_minute", "hour_n"))
    hours = scan.totals_before(c, ["client", "_day"], "_hour", F.count("*"), "_earlier")
    c = c.join(hours, ["client", "_day", "_hour"]).withColumn(
        "day_n", F.col("hour_n") + F.col("_earlier"))
    exempt = F.col("client").cast("string").isin(LOOPBACK)
    return (c.withColumn("allowed", exempt | ((F.col("hour_n") <= per_hour)
                                              & (F.col("day_n") <= per_day)))
            .drop("_hour", "_day", "_minute", "_earlier"))


def fast_empty_streaks(calls: DataFrame, keys: list[str], fast_s: float = 2.0, limit: int = 3,
                       slice_s: int = DAY) -> DataFrame:
    """``streak`` of fast empty results up to each call, and ``alarm`` at ``limit``.

    A call with blocks resets the streak; a slow empty call leaves it as it is.
    """
    reset = F.col("n_blocks") > 0
    fast = (F.col("n_blocks") == 0) & (F.col("elapsed_s") < fast_s)
    c = calls.withColumn("_slice", F.floor(seconds(F.col("ts")) / slice_s))
    order = ["ts", "event_id"]
    c = checkpointed(scan.running_total(c, keys, order, "_slice", fast.cast("bigint"), "_fast"))
    c = scan.latest(c, keys, order, "_slice", F.when(reset, F.col("_fast")), "_at_reset")
    streak = F.col("_fast") - F.coalesce("_at_reset", F.lit(0))
    return (c.withColumn("streak", streak)
            .withColumn("alarm", fast & (F.col("streak") >= limit))
            .drop("_fast", "_at_reset", "_slice"))


# --- page decisions ----------------------------------------------------------------------------

WEAK_BLOCKS, WEAK_CONF = 3, 0.45

def page_trigger(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``trigger`` and ``reason`` per page (page_id, big_panel, forced, disabled)."""
    seen = blocks.groupBy("page_id").agg(
        F.count("*").alias("n_blocks"),
        (F.sum(F.round(F.coalesce("confidence", F.lit(0.0)) * 1_000_000).cast("bigint"))
         / F.count("*") / 1_000_000).alias("avg_conf"))
    j = pages.join(seen, "page_id", "left").na.fill(0, ["n_blocks"]).na.fill(0.0, ["avg_conf"])
    n, conf = F.col("n_blocks"), F.col("avg_conf")
    panel = F.col("big_panel") & ~((n >= 3) & (conf >= 0.75))
    reason = (F.when(F.col("forced"), "forced").when(n == 0, "no_blocks")
              .when(panel, "large_image_panel")
              .when((n < 3) & (conf < 0.20), "low_block_count_and_confidence")
              .otherwise("threshold_not_met"))
    return (j.withColumn("reason", reason)
            .withColumn("trigger", ~F.col("disabled") & (F.col("reason") != "threshold_not_met")))


def cascade_gate(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Which tiers a page (page_id, big_panel) still needs, from its blocks so far."""
    seen = page_trigger(blocks, pages.withColumn("forced", F.lit(False))
                        .withColumn("disabled", F.lit(False)))
    n, conf = F.col("n_blocks"), F.col("avg_conf")
    return (seen.withColumn("run_second", (n < 3) | (conf < 0.20))
            .withColumn("run_regions", (n < 3) | (conf < 0.35))
            .withColumn("try_aggressive", F.col("trigger") & ~F.col("big_panel") & (conf < 0.35))
            .withColumn("aggressive_ok", (n >= 3) & (conf >= 0.30)))


def pick_best_pass(passes: DataFrame, first, second) -> DataFrame:
    """Of two reads of a page (page_id, read, confidence): the second if its mean is better
    or it has more blocks."""
    def n(which):
        return F.count_if(F.col("read") == which)

    def mean(which):
        return (F.sum(F.when(F.col("read") == which, F.round(F.col("confidence") * 1_000_000)
                             .cast("bigint"))) / n(which) / 1_000_000)

    p = passes.groupBy("page_id").agg(n(first).alias("n_first"), n(second).alias("n_second"),
                                      mean(first).alias("conf_first"),
                                      mean(second).alias("conf_second"))
    better = (F.col("n_second") > 0) & (
        (F.coalesce("conf_second", F.lit(0.0)) > F.coalesce("conf_first", F.lit(0.0)))
        | (F.col("n_second") > F.col("n_first")))
    return p.withColumn("picked", F.when(better, F.lit(second)).otherwise(F.lit(first)))


def decision_stats(decisions: DataFrame) -> DataFrame:
    """Counts over decisions (n_blocks, avg_conf, decision, recomputes)."""
    weak = (F.col("n_blocks") < WEAK_BLOCKS) | (F.col("avg_conf") < WEAK_CONF)
    yes, again = F.col("decision"), F.col("recomputes") >= 1
    return decisions.agg(
        F.count_if(yes).alias("positive"), F.count_if(~yes & weak).alias("weak_negative"),
        F.count_if(~yes & ~weak).alias("strong_negative"), F.count_if(again).alias("recomputed"),
        F.count_if(yes & again).alias("flipped"))


# --- strips ------------------------------------------------------------------------------------

def _next_starts(heights: list[int], limit: int, gap: int) -> list[int]:
    """For an item that opens a strip, the item that opens the next one."""
    out, end, height = [], 0, 0
    for i in range(len(heights)):
        if end <= i:
            end, height = i + 1, heights[i]
        while end < len(heights) and height + gap + heights[end] <= limit:
            height += gap + heights[end]
            end += 1
        out.append(end)
        if end > i + 1:
            height -= heights[i] + gap
    return out


def _chunk_strips(rows: list[dict], limit: int, gap: int) -> tuple:
    """What a chunk does for each possible first strip opened inside it: strips opened, and the
    height of the last one. Only items that could still fit a strip from before can be first."""
    heights = [r["height"] for r in rows]
    jumps = _next_starts(heights, limit, gap)
    n = len(heights)
    opened, last = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = jumps[i]
        opened[i] = 1 + opened[j] if j < n else 1
        last[i] = last[j] if j < n else sum(heights[i:n]) + gap * (n - 1 - i)
    head, height = [], -gap
    for h in heights:
        head.append(h)
        height += gap + h
        if height > limit:
            break
    k = len(head) + 1
    return head, opened[:k], last[:k]


def pack_strips(items: DataFrame, key: str, order: str, max_height: int = 1900, gap: int = 24,
                chunk: int = 4096) -> DataFrame:
    """Pack items (key, order, height) in order into strips of at most ``max_height``.

    Adds ``strip_no`` and ``top``. Where a strip ends depends on everything before it, but a
    chunk can only be entered in as many ways as items fit one strip. Chunks are solved for
    every entry, put in order with one small state per key, and then run from the known entry.
    """
    kind = items.schema[key].dataType.simpleString()
    ranked = scan.rank(items.withColumn("_b", F.floor(F.col(order) / chunk)), [key], [order], "_b",
                       "_n")
    cut = ranked.withColumn("_chunk", F.floor((F.col("_n") - 1) / chunk)).select(
        key, F.col(order).cast("bigint").alias("_o"), F.col("height").cast("bigint")
        .alias("height"), "_chunk")

    def solve(rows: list[dict]):
        return [(rows[0][key], rows[0]["_chunk"], len(rows),
                 *_chunk_strips(rows, max_height, gap))]

    solved = fold_groups(cut, [key, "_chunk"], ["_o"], solve,
                         f"{key} {kind}, _chunk bigint, n bigint, head array<bigint>, "
                         "opened array<bigint>, last array<bigint>")

    def enter(state: tuple, row: dict):
        strip, height = state
        result = (row[key], row["_chunk"], strip, height)
        fits, h = 0, height
        while h > 0 and fits < len(row["head"]) and h + gap + row["head"][fits] <= max_height:
            h += gap + row["head"][fits]
            fits += 1
        if fits == row["n"]:
            return (strip, h), result
        return (strip + row["opened"][fits], row["last"][fits]), result

    entries = fold_stream(solved, [key], ["_chunk"], lambda: (-1, 0), enter,
                          f"{key} {kind}, _chunk bigint, _strip bigint, _height bigint")

    def run(rows: list[dict]):
        strip, height = rows[0]["_strip"], rows[0]["_height"]
        for r in rows:
            if height and height + gap + r["height"] <= max_height:
                top = height + gap
                height = top + r["height"]
            else:
                strip, top, height = strip + 1, 0, r["height"]
            yield r[key], r["_o"], strip, top, r["height"]

    return fold_groups(cut.join(entries, [key, "_chunk"]), [key, "_chunk"], ["_o"], run,
                       f"{key} {kind}, {order} bigint, strip_no bigint, top bigint, "
                       "height bigint")


# --- signatures --------------------------------------------------------------------------------

def layout_signature(grids: DataFrame, cells: str = "cells") -> DataFrame:
    """64 ink cells to a signature ``ratio:bits:digest``, with ``big_panel`` at 0.18 ink."""
    ones = F.aggregate(cells, F.lit(0), lambda acc, c: acc + c)
    ratio = F.col("_ones") / F.size(cells)
    digest = F.substring(F.md5(F.array_join(F.transform(cells, lambda c: c.cast("string")), "")),
                         1, 16)
    # the first cell is the lowest bit, so the cells are read from the end
    return (grids.withColumn("bits", F.aggregate(
        F.reverse(cells), F.lit(0).cast("bigint"),
        lambda acc, c: F.shiftleft(acc, 1).bitwiseOR(c.cast("bigint"))))
        .withColumn("_ones", ones).withColumn("ink", F.round(ratio, 1))
        .withColumn("big_panel", ratio > 0.18)
        .withColumn("signature", F.concat_ws(":", F.format_string("%.1f", F.col("ink")),
                                             F.lpad(F.lower(F.hex("bits")), 64, "0"), digest))
        .drop("_ones"))


def signature_stats(pages: DataFrame) -> DataFrame:
    """Per document: pages, distinct, blank and repeated signatures, pages they cover."""
    per = (pages.groupBy("doc_id", F.coalesce("signature", F.lit("")).alias("s"))
           .agg(F.count("*").alias("n")))
    blank = F.col("s") == ""
    many = (F.col("n") > 1) & ~blank
    return per.groupBy("doc_id").agg(
        F.sum("n").alias("pages"), F.count_if(~blank).alias("distinct_signatures"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank_pages"),
        F.count_if(many).alias("repeated"),
        F.sum(F.when(many, F.col("n")).otherwise(0)).alias("pages_repeated"))


def signature_collisions(pages: DataFrame, first, second) -> DataFrame:
    """Signatures two documents share: raw, affected pages of each, and with scoped keys.

    Counted per (document, signature) first; the shared ones follow from one more aggregation,
    without pairing pages.
    """
    per = (pages.where(F.col("doc_id").isin(first, second) & (F.coalesce("signature", F.lit(""))
                                                              != ""))
           .groupBy("signature").agg(F.count_if(F.col("doc_id") == first).alias("a"),
                                     F.count_if(F.col("doc_id") == second).alias("b")))
    shared = (F.col("a") > 0) & (F.col("b") > 0)
    return per.agg(F.count_if(F.col("a") > 0).alias("signatures_a"),
                   F.count_if(F.col("b") > 0).alias("signatures_b"),
                   F.count_if(shared).alias("shared"),
                   F.sum(F.when(shared, F.col("a")).otherwise(0)).alias("pages_a"),
                   F.sum(F.when(shared, F.col("b")).otherwise(0)).alias("pages_b")).withColumn(
        "shared_scoped", F.lit(0).cast("bigint") if first != second else F.col("shared"))


BANDS = [(0, 10), (10, 11), (21, 11), (32, 10), (42, 11), (53, 11)]  # offset and width of 64 bits


def near_signatures(a: DataFrame, b: DataFrame, k: int = 4) -> DataFrame:
    """Pairs of distinct 64-bit grids (bits) that differ in at most ``k`` ≤ 4 cells.

    Four changed cells leave at least two of six bands untouched, so the grids meet on some
    pair of equal bands (about 21 bits, far more selective than one band). A pair that meets
    on several is kept at the first. Repeated grids are joined once, as one row.
    """
    if k > len(BANDS) - 2:
        raise ValueError("at least two bands have to stay equal")
    choices = [(i, j) for i in range(len(BANDS)) for j in range(i + 1, len(BANDS))]

    def band(c: Column, i: int) -> Column:
        at, width = BANDS[i]
        return F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << width) - 1))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(n).alias("c"), band(F.col(name), i).alias("u"),
                         band(F.col(name), j).alias("v")) for n, (i, j) in enumerate(choices)]
        return df.withColumn("_key", F.explode(F.array(*keys)))

    x = keyed(a.select(F.col("bits").alias("bits_a")).distinct(), "bits_a")
    y = keyed(b.select(F.col("bits").alias("bits_b")).distinct(), "bits_b")
    differ = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    first = None
    for n, (i, j) in enumerate(choices):
        same = (band(differ, i) == 0) & (band(differ, j) == 0)
        first = F.when(same, n) if first is None else first.when(same, n)
    return (x.join(y, "_key").where(F.bit_count(differ) <= k).where(F.col("_key.c") == first)
            .select("bits_a", "bits_b", F.bit_count(differ).alias("cells")))


def attribute_calls(calls: DataFrame, pages: DataFrame, start: float, end: float) -> DataFrame:
    """Calls (call_id, signature, ts) in a time window with their candidate pages.

    Pages are reduced per signature before the join: how many, the first, and whether the
    attribution is ambiguous; the candidates themselves stay available by joining ``pages``.
    """
    t = seconds(F.col("ts"))
    per = pages.groupBy("signature").agg(F.count_distinct("page_id").alias("candidates"),
                                         F.min("page_id").alias("first_page"))
    return (calls.where(t.between(start, end)).join(per, "signature", "left")
            .na.fill(0, ["candidates"])
            .withColumn("ambiguous", F.col("candidates") > 1))
