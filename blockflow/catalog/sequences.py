"""Arrival-order jobs, signatures and logs over events, embeddings and documents."""

from pyspark.sql import functions as F

from blockflow.fixtures import cte
from blockflow.operators import logs as lo
from blockflow.operators import scan
from blockflow.operators import sequences as s
from blockflow.rules import patterns as pt

START, END = 1704585600.0, 1705190400.0  # one week


def panels(fx):
    return fx.documents.select(
        F.col("doc_id").alias("page_id"), (F.col("doc_id") % 4 == 1).alias("big_panel"),
        (F.col("doc_id") % 50 == 7).alias("forced"), (F.col("doc_id") % 50 == 8).alias("disabled"))


def few_blocks(fx):
    """Blocks of weak pages: low confidences only."""
    return fx.blocks.where("confidence < 0.3 and engine = 2 and page_id % 3 <> 0").unionByName(
        fx.blocks.where("page_id % 3 = 0"))


FEW = cte("blocks") + """, few as (select * from blocks where (confidence < 0.3 and engine = 2 and page_id % 3 <> 0) or page_id % 3 = 0),
panels as (select doc_id as page_id, doc_id % 4 = 1 as big_panel, doc_id % 50 = 7 as forced, doc_id % 50 = 8 as disabled from documents),
seen as (select page_id, count(*) as n, sum(cast(round(confidence * 1000000) as bigint)) / count(*) / 1000000 as c from few group by 1),
j as (select p.*, coalesce(n, 0) as n_blocks, coalesce(c, 0) as avg_conf from panels p left join seen using (page_id))
"""


def signed(fx):
    """Few cells only, so that signatures repeat across documents."""
    short = fx.grids.withColumn("cells", F.concat(F.slice("cells", 1, 7), F.array_repeat(
        F.lit(0), 57)))
    return s.layout_signature(short).withColumn("signature", F.when(
        F.col("vec_id") % 17 > 0, F.col("signature")))


BITS = ("cast(list_sum(list_transform(range(1, 65), lambda k: case when cells[k] = 1 and k < 64 then "
        "(1::hugeint << (k - 1)) when cells[k] = 1 then -(1::hugeint << 63) else 0 end)) as bigint)")
SIGNED = cte("grids") + """, signed as (select vec_id, doc_id, case when vec_id % 17 > 0 then array_to_string(cells[1:7], '') end as g from grids)
"""


def near_input(fx):
    """Grids and copies of them with up to five cells flipped."""
    sig = s.layout_signature(fx.grids)
    flip = F.expr("cast(vec_id % 6 as int)")
    changed = fx.grids.withColumn("cells", F.transform("cells", lambda v, k: F.when(
        (k % 11 == 3) & (k < flip * 11), 1 - v).otherwise(v)))
    return sig, s.layout_signature(changed)


def numbered(fx):
    """Log lines with their true number in each file."""
    return scan.rank(fx.log_lines.withColumn("_b", F.floor(F.col("event_id") / 1024)), ["file"],
                     ["event_id"], "_b", "line_no").drop("_b")


CATEGORY = " ".join(f"when regexp_matches(line, '{p}') then '{n}'" for n, p in pt.LOG_CATEGORIES)
CONTEXT = cte("log_lines") + """, ctx as (select *, last_value(nullif(regexp_extract(line, 'text=''([^'']+)''', 1), '') ignore nulls) over (partition by file order by event_id rows between 30 preceding and 1 preceding) as context from log_lines)
"""
CLASSED = CONTEXT + f", classed as (select * from (select *, case {CATEGORY} end as category from ctx) where category is not null)\n"

QUERIES = {
    "rate_limit": lambda fx: s.rate_limit(fx.calls, 2, 5).select(
        "event_id", "hour_n", "day_n", "allowed"),
    "fast_empty_streaks": lambda fx: s.fast_empty_streaks(fx.calls, ["client"], 20.0).select(
        "event_id", "streak", "alarm"),
    "fast_empty_streaks_all": lambda fx: s.fast_empty_streaks(fx.calls, [], 20.0).select(
        "event_id", "streak", "alarm"),
    "page_trigger": lambda fx: s.page_trigger(few_blocks(fx), panels(fx)).select(
        "page_id", "n_blocks", "avg_conf", "trigger", "reason"),
    "cascade_gate": lambda fx: s.cascade_gate(few_blocks(fx), panels(fx).select(
        "page_id", "big_panel")).select("page_id", "run_second", "run_regions", "try_aggressive",
                                        "aggressive_ok"),
    "pick_best_pass": lambda fx: s.pick_best_pass(fx.blocks.where("engine > 0").select(
        "page_id", F.col("engine").alias("read"), "confidence"), 1, 2),
    "decision_stats": lambda fx: s.decision_stats(fx.page_stream.select(
        "n_blocks", "avg_conf", F.col("gained").alias("decision"), (F.col("event_id") % 2)
        .alias("recomputes"))),
    "pack_strips": lambda fx: s.pack_strips(fx.blocks.where("engine = 0").withColumn(
        "height", F.col("h") * 9), "page_id", "i"),
    "layout_signature": lambda fx: s.layout_signature(fx.grids).select(
        "vec_id", "bits", "ink", "big_panel", "signature"),
    "signature_stats": lambda fx: s.signature_stats(signed(fx)),
    "signature_collisions": lambda fx: s.signature_collisions(signed(fx), 0, 1),
    "near_signatures": lambda fx: s.near_signatures(*near_input(fx)),
    "attribute_calls": lambda fx: s.attribute_calls(
        fx.events.select(F.col("event_id").alias("call_id"), (F.col("user_id") % 61).cast(
            "string").alias("signature"), "ts"),
        fx.pages.select("page_id", (F.col("page_id") % 47).cast("string").alias("signature")),
        START, END).select("call_id", "candidates", "first_page", "ambiguous"),
    "last_seen_text": lambda fx: lo.last_seen_text(numbered(fx), 30, 512).select(
        "event_id", "context"),
    "classify_log": lambda fx: lo.classify_log(fx.log_lines).select("event_id", "category"),
    "log_summary": lambda fx: lo.log_summary(fx.log_lines),
    "top_contexts": lambda fx: lo.top_contexts(lo.classify_log(lo.last_seen_text(
        numbered(fx)))),
    "log_samples": lambda fx: lo.log_samples(lo.classify_log(numbered(fx))).select(
        "category", "file", "line_no"),
    "log_metrics": lambda fx: lo.log_event_counts(lo.log_metrics(fx.events.select(
        F.when(F.col("event_id") % 3 == 0, F.format_string(
            "[process-page] %.1fs | %d bloques | [x]", "value", "user_id")).when(
            F.col("event_id") % 3 == 1, F.format_string(
                "[YOLO] %d regiones de diálogo detectadas", "user_id")).otherwise(
            F.lit("decisión cacheada por firma")).alias("line")))),
}

ORACLES = {
    "rate_limit": """with n as (select event_id, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as hour_n, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) as day_n from events)
      select *, hour_n <= 2 and day_n <= 5 as allowed from n""",
    "fast_empty_streaks": cte("calls") + """, f as (select *, n_blocks = 0 and elapsed_s < 20 as fast, sum(case when n_blocks > 0 then 1 else 0 end) over (partition by client order by ts, event_id) as g from calls),
      r as (select *, sum(case when fast then 1 else 0 end) over (partition by client, g order by ts, event_id) as streak from f) select event_id, streak::bigint as streak, fast and streak >= 3 as alarm from r""",
    "fast_empty_streaks_all": cte("calls") + """, f as (select *, n_blocks = 0 and elapsed_s < 20 as fast, sum(case when n_blocks > 0 then 1 else 0 end) over (order by ts, event_id) as g from calls),
      r as (select *, sum(case when fast then 1 else 0 end) over (partition by g order by ts, event_id) as streak from f) select event_id, streak::bigint as streak, fast and streak >= 3 as alarm from r""",
    "page_trigger": FEW + """, r as (select *, case when forced then 'forced' when n_blocks = 0 then 'no_blocks' when big_panel and not (n_blocks >= 3 and avg_conf >= 0.75) then 'large_image_panel'
        when n_blocks < 3 and avg_conf < 0.20 then 'low_block_count_and_confidence' else 'threshold_not_met' end as reason from j)
      select page_id, n_blocks, avg_conf, not disabled and reason <> 'threshold_not_met' as trigger, reason from r""",
    "cascade_gate": FEW + """, r as (select *, n_blocks = 0 or (big_panel and not (n_blocks >= 3 and avg_conf >= 0.75)) or (n_blocks < 3 and avg_conf < 0.20) as trig from j)
      select page_id, n_blocks < 3 or avg_conf < 0.20 as run_second, n_blocks < 3 or avg_conf < 0.35 as run_regions, trig and not big_panel and avg_conf < 0.35 as try_aggressive, n_blocks >= 3 and avg_conf >= 0.30 as aggressive_ok from r""",
    "pick_best_pass": cte("blocks") + """, p as (select page_id, count(*) filter (engine = 1) as n_first, count(*) filter (engine = 2) as n_second,
        sum(cast(round(confidence * 1000000) as bigint)) filter (engine = 1) / count(*) filter (engine = 1) / 1000000 as conf_first,
        sum(cast(round(confidence * 1000000) as bigint)) filter (engine = 2) / nullif(count(*) filter (engine = 2), 0) / 1000000 as conf_second from blocks where engine > 0 group by 1)
      select *, case when n_second > 0 and (coalesce(conf_second, 0) > coalesce(conf_first, 0) or n_second > n_first) then 2 else 1 end as picked from p""",
    "decision_stats": cte("page_stream") + """, d as (select *, n_blocks < 3 or avg_conf < 0.45 as weak, event_id % 2 >= 1 as again from page_stream)
      select count(*) filter (gained) as positive, count(*) filter (not gained and weak) as weak_negative, count(*) filter (not gained and not weak) as strong_negative, count(*) filter (again) as recomputed, count(*) filter (gained and again) as flipped from d""",
    "layout_signature": cte("grids") + f""", g as (select vec_id, {BITS} as bits, list_sum(cells) / 64 as r, cells from grids)
      select vec_id, bits, round(r, 1) as ink, r > 0.18 as big_panel, format('{{:.1f}}', round(r, 1)) || ':' || lpad(lower(to_hex(bits)), 64, '0') || ':' || substr(md5(array_to_string(cells, '')), 1, 16) as signature from g""",
    "signature_stats": SIGNED + """, p as (select doc_id, coalesce(g, '') as g, count(*) as n from signed group by 1, 2)
      select doc_id, sum(n)::bigint as pages, count(*) filter (g <> '') as distinct_signatures, sum(case when g = '' then n else 0 end)::bigint as blank_pages, count(*) filter (n > 1 and g <> '') as repeated, sum(case when n > 1 and g <> '' then n else 0 end)::bigint as pages_repeated from p group by 1""",
    "signature_collisions": SIGNED + """, p as (select g, count(*) filter (doc_id = 0) as a, count(*) filter (doc_id = 1) as b from signed where g is not null and doc_id in (0, 1) group by 1)
      select count(*) filter (a > 0) as signatures_a, count(*) filter (b > 0) as signatures_b, count(*) filter (a > 0 and b > 0) as shared, sum(case when a > 0 and b > 0 then a else 0 end)::bigint as pages_a, sum(case when a > 0 and b > 0 then b else 0 end)::bigint as pages_b, 0::bigint as shared_scoped from p""",
    "near_signatures": cte("grids") + f""", a as (select distinct {BITS} as bits_a from grids),
      f as (select list_transform(cells, lambda v, k: case when (k - 1) % 11 = 3 and k - 1 < (vec_id % 6) * 11 then 1 - v else v end) as cells from grids), b as (select distinct {BITS} as bits_b from f)
      select bits_a, bits_b, cast(bit_count(xor(bits_a, bits_b)) as int) as cells from a cross join b where bit_count(xor(bits_a, bits_b)) <= 4""",
    "attribute_calls": f"""with p as (select cast(page_id % 47 as varchar) as sig, count(distinct page_id) as candidates, min(page_id) as first_page from pages group by 1)
      select event_id as call_id, coalesce(candidates, 0) as candidates, first_page, coalesce(candidates, 0) > 1 as ambiguous from events left join p on sig = cast(user_id % 61 as varchar) where epoch_us(ts) / 1000000 between {START} and {END}""",
    "last_seen_text": CONTEXT + "select event_id, context from ctx",
    "classify_log": CLASSED + "select event_id, category from classed",
    "log_summary": CLASSED + f"select category, count(*) as n, count(distinct file) as files, (select count(*) from classed where category in ({','.join(repr(c) for c in pt.LOST_CATEGORIES)})) as lost_blocks, count(*) * 100.0::double / (select count(*) from log_lines) as share_pct from classed group by 1",
    "top_contexts": CLASSED + ", c as (select category, context, count(*) as n from classed where context is not null group by 1, 2) select *, row_number() over (partition by category order by n desc, context) as place from c qualify place <= 8",
    "log_samples": CLASSED + ", k as (select event_id, row_number() over (partition by file order by event_id) as line_no from log_lines) select category, file, line_no from classed join k using (event_id) qualify row_number() over (partition by category order by file, line_no) <= 5",
}
