"""Run analytics over ``page_runs``, ``batch_results``, documents and orders."""

from pyspark.sql import functions as F

from blockflow.catalog import duck
from blockflow.fixtures import cte
from blockflow.operators import runs as r
from blockflow.rules import effects as ef


def statused(fx):
    """Every attempt of ``page_runs`` with its status."""
    error = F.when(F.col("status_raw") != "done", F.col("status_raw"))
    return r.page_status(fx.page_runs.withColumn("attempt", F.col("event_id") % 3)
                         .withColumn("error", error))


STATUS = cte("page_runs") + """, statused as (select *, event_id % 3 as attempt,
   case when status_raw <> 'done' then status_raw else
   (case when n_translated = n_blocks and n_blocks > 0 then 'OK' when n_translated > 0 then 'PARCIAL'
     when n_blocks > 0 then 'SIN_TRAD' else 'VACIO' end) || case when event_id % 3 > 0 then '_R' || (event_id % 3) else '' end end as status
   from page_runs),
failed as (select *, status in ('timeout','render_error','conn_error') or starts_with(status, 'http') as bad from statused)
"""
STATS_SQL = """sum(case when not bad then n_blocks else 0 end)::bigint as total_blocks_found,
  sum(case when not bad then n_translated else 0 end)::bigint as total_blocks_translated,
  count(*) filter (not bad and n_blocks > 0) as pages_with_text,
  count(*) filter (not bad and n_blocks > 0 and n_translated > 0) as pages_translated,
  count(*) filter (not bad and n_blocks = 0) as pages_empty, count(*) filter (bad) as pages_error"""
RATE = "total_blocks_translated * 100.0::double / greatest(total_blocks_found, 1) as translation_rate"
LATEST = STATUS + ", last as (select * from failed qualify row_number() over (partition by run, page order by ts desc, event_id desc) = 1)"


def last_pages(fx, run=None):
    last = r.latest_attempt(statused(fx), ["run", "page"], ["ts", "event_id"])
    return last if run is None else last.where(F.col("run") == run)


def trial(fx):
    """Events as repetitions of a trial; a fifth of the pages do not use the stage."""
    page = F.floor(F.col("event_id") / 6)
    return fx.events.select(
        page.alias("page"), F.when(F.col("event_id") % 2 == 0, "base").otherwise("alt").alias("arm"),
        F.floor(F.col("event_id") % 6 / 2).alias("rep"), F.col("value").alias("total_s"),
        (F.col("event_id") % 9).alias("n_blocks"),
        F.when(page % 5 == 0, 0.0).otherwise(F.col("value")).alias("stage_s"))


TRIAL = """with trial as (select event_id // 6 as page, case when event_id % 2 = 0 then 'base' else 'alt' end as arm,
   (event_id % 6) // 2 as rep, value as total_s, event_id % 9 as n_blocks, case when (event_id // 6) % 5 = 0 then 0.0 else value end as stage_s from events),
mid as (select * from trial qualify row_number() over (partition by page, arm order by total_s, rep) = count(*) over (partition by page, arm) // 2 + 1),
pp as (select page, max(cast(round(total_s * 100) as bigint)) filter (arm = 'base') as bcs, max(cast(round(total_s * 100) as bigint)) filter (arm = 'alt') as acs,
   max(n_blocks) filter (arm = 'base') as bb, max(n_blocks) filter (arm = 'alt') as ab, max(stage_s) filter (arm = 'base') as st from mid group by page),
ok as (select *, acs - bcs as d, st = 0 as c from pp where bcs is not null and acs is not null)
"""


def records(fx):
    """Page benchmark records: events with stage and call maps."""
    cs = r.cents(F.col("value"))
    detect = F.floor(cs * 6 / 10)
    return fx.events.select(
        F.col("event_id").alias("page"), F.col("value").alias("total_s"),
        (F.col("event_id") % 9).alias("n_blocks"), (F.col("event_id") % 4 == 0).alias("trigger"),
        (F.col("event_id") % 8 == 0).alias("vlm_called"),
        F.when(F.col("event_id") % 16 == 0, 2).otherwise(0).alias("vlm_recovered"),
        (F.col("event_id") % 20 == 4).alias("salvaged"),
        F.when(F.col("event_id") % 20 == 4, 1).otherwise(0).alias("aggressive_calls"),
        F.create_map(F.lit("detect"), detect / 100, F.lit("recognise"), (cs - detect) / 100)
        .alias("stages"),
        F.create_map(F.lit("yolo"), (F.col("event_id") % 3).cast("int"), F.lit("ctd"),
                     (F.col("event_id") % 5).cast("int")).alias("calls"))


def metrics(fx):
    """Share of English documents per source, in percent."""
    return fx.documents.groupBy(F.col("source").alias("name")).agg(
        (F.count_if(F.col("lang") == "en") * 100.0 / F.count("*")).alias("value"))


def limits(fx):
    return fx.documents.where("doc_id % 20 <> 7").groupBy(F.col("source").alias("name")).agg(
        (F.lit(55.0) + F.min("doc_id") % 10).alias("threshold"))


def snapshot(fx):
    return fx.documents.join(fx.labels, "doc_id").groupBy(F.col("source").alias("name")).agg(
        (F.sum("quality") * 100.0 / F.count("*")).alias("value"))


def library(fx):
    """Documents as pages of chapters of series; one source in five is a copy."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return fx.documents.select(
        F.when(number % 5 == 3, F.concat("source", F.lit(" (1)"))).otherwise(F.col("source"))
        .alias("series"), (F.col("n_chars") % 10).alias("chapter"), F.col("doc_id").alias("page"))


LIBRARY = """with lib as (select case when cast(regexp_extract(source, '(\\d+)', 1) as int) % 5 = 3 then source || ' (1)' else source end as series,
   n_chars % 10 as chapter, doc_id as page from documents),
used as (select distinct source as series, n_chars % 10 as chapter from documents join labels using (doc_id) where toxic = 1),
fresh as (select *, row_number() over (partition by series, chapter order by page) as k from lib
   where not regexp_matches(series, '\\(\\d+\\)$') and (series, chapter) not in (select series, chapter from used)),
sizes as (select series, chapter, count(*) as size, case when count(*) > 4 then 2 else 0 end as skip from fresh group by 1, 2),
offs as (select *, coalesce(sum(size - 2 * skip) over (partition by series order by chapter rows between unbounded preceding and 1 preceding), 0) as off from sizes),
kept as (select * from offs where off < 20),
tot as (select series, cast(sum(size - 2 * skip) as bigint) as c from kept group by 1),
picks as (select distinct series, case when least(10, c) > 1 then cast(round_even(i * (c - 1) / (least(10, c) - 1), 0) as bigint) else 0 end as pos
   from (select series, c, unnest(range(least(10, c))) as i from tot where c > 0))
select series, chapter, page from fresh join kept using (series, chapter) join picks using (series)
where k > skip and k <= size - skip and pos = off + k - skip - 1"""


def attempts_pairs(fx):
    return fx.pairs.withColumn("page_id", F.col("doc_id"))


def conv_pages(fx):
    return fx.conversations.groupBy(F.col("conv_id").alias("page_id")).agg(
        F.when(F.max("turn") % 4 == 0, "timeout").otherwise("OK").alias("status"))


REPAIR = (f"(regexp_matches(z, '^\\p{{L}}{{3,8}}$') and z not in {duck.sql_in(ef.REPAIR_NOT_EFFECTS)} "
          f"and (z in {duck.sql_in(ef.REPAIR_EFFECTS)} or {duck.triple('z')}))")

QUERIES = {
    "page_status": lambda fx: statused(fx).select("event_id", "status"),
    "run_stats": lambda fx: r.run_stats(statused(fx), "run"),
    "pending": lambda fx: r.pending(
        fx.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page")),
        fx.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("doc_id"),
                                                      F.col("o_orderkey").alias("page")),
        fx.orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(
            (F.count("*") + F.when(F.max("o_orderkey") % 3 == 0, 1).otherwise(0))
            .alias("total_pages"))),
    "latest_attempt": lambda fx: last_pages(fx).select(
        "run", "page", "event_id", "status", "attempts"),
    "failed_work": lambda fx: r.silent_failures(attempts_pairs(fx), conv_pages(fx)).select(
        "doc_id", "seq"),
    "failed_pages": lambda fx: r.failed_pages(statused(fx)).groupBy("run", "status").agg(
        F.count("*").alias("n")),
    "compare_runs": lambda fx: r.compare_runs(last_pages(fx, "A"), last_pages(fx, "B")),
    "changed_texts": lambda fx: r.changed_texts(
        fx.blocks.where("engine = 0").select(F.col("page_id").alias("page"), F.col("i").alias("pos"),
                                             F.col("text").alias("src"), F.col("type").alias("tgt")),
        fx.blocks.where("engine = 2").select(F.col("page_id").alias("page"), F.col("i").alias("pos"),
                                             F.col("text").alias("src"), F.col("type").alias("tgt"))),
    "metric_deltas": lambda fx: r.metric_deltas(r.run_stats(statused(fx), "run"), "A", "B"),
    "ab_effect": lambda fx: r.ab_effect(trial(fx)),
    "latency_report": lambda fx: r.latency_report(fx.page_runs.withColumn(
        "ok", F.col("status_raw") == "done"), 200.0, "run"),
    "latency_histogram": lambda fx: r.latency_histogram(fx.page_runs),
    "memory_growth": lambda fx: r.memory_growth(fx.events.select(
        "ts", F.col("value").alias("rss_mb"), (F.col("event_type") != "error").alias("ok"))),
    "production_summary": lambda fx: r.production_summary(records(fx)),
    "stage_share": lambda fx: r.stage_share(records(fx)),
    "mode_summary": lambda fx: r.mode_summary(fx.page_runs.select(
        F.col("status_raw").alias("mode"), "elapsed_s", "n_blocks",
        (F.col("n_blocks") == 0).alias("error"))),
    "with_and_without": lambda fx: r.with_and_without(fx.page_runs.select(
        "page", (F.col("run") == "A").alias("step"), "n_blocks", "elapsed_s")),
    "metric_gate": lambda fx: r.metric_gate(
        metrics(fx), limits(fx), snapshot(fx),
        fx.documents.where("lang = 'es'").select(F.col("source").alias("name"))),
    "round_history": lambda fx: r.round_history(
        fx.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(
            F.count("*").alias("score")), ["event_type"], "day", "score").select(
        "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "score", "step",
        "since_first"),
    "share_batch_time": lambda fx: r.share_batch_time(
        fx.batch_results.select("batch_id", "page"),
        fx.batch_results.where("event_type <> 'error'").select(
            "batch_id", "page", "batch_elapsed_s", (F.col("event_type") != "view").alias("ok"))),
    "make_batches": lambda fx: r.make_batches(
        fx.events.select("user_id", "event_id"), ["user_id"], "event_id", 4, 1 << 12).groupBy(
        "user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")),
    "sample_pages": lambda fx: r.sample_pages(library(fx), fx.documents.join(
        fx.labels.where("toxic = 1"), "doc_id").select(
        F.col("source").alias("series"), (F.col("n_chars") % 10).alias("chapter")), 10),
    "training_set": lambda fx: r.training_set(
        fx.documents.select(F.col("doc_id").alias("page_id"), F.when(
            F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split")),
        fx.pages.select("page_id")).groupBy("split").agg(F.count("*").alias("n")),
    "split_check": lambda fx: r.split_check(fx.documents.select(F.when(
        F.col("lang") == "en", "train").otherwise("extra").alias("split"))),
    "text_sets": lambda fx: r.text_sets(
        fx.blocks.where("engine = 0").select("page_id", "text"),
        fx.blocks.where("engine = 1").select("page_id", "text")),
    "compact_ranges": lambda fx: r.compact_ranges(
        fx.events.where("event_type <> 'error'").select("event_type", "event_id"), "event_type",
        "event_id", 1 << 10),
    "range_text": lambda fx: r.range_text(r.compact_ranges(
        fx.blocks.where("engine = 2").select("page_id", "i"), "page_id", "i"), "page_id"),
    "union_sources": lambda fx: fx.blocks.where("engine = 0").drop("engine").withColumn(
        "source", F.lit("easyocr")).unionByName(fx.blocks.where("engine = 1").drop("engine")
                                                .withColumn("source", F.lit("rapid"))).groupBy(
        "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    "updated_first": lambda fx: fx.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated")).orderBy(
        F.desc("updated"), "o_orderkey"),
}

ORACLES = {
    "page_status": STATUS + "select event_id, status from statused",
    "run_stats": STATUS + f"select *, {RATE} from (select run, {STATS_SQL} from failed group by run)",
    "pending": """with n as (select o_custkey, count(*) as now, count(*) + case when max(o_orderkey) % 3 = 0 then 1 else 0 end as saved from orders group by 1)
      select o_custkey as doc_id, o_orderkey as page from orders where not (o_orderstatus = 'F' and o_custkey in (select o_custkey from n where now = saved))""",
    "latest_attempt": STATUS + """select run, page, event_id, status, attempts from (select *, count(*) over (partition by run, page) as attempts,
       row_number() over (partition by run, page order by ts desc, event_id desc) as k from statused) where k = 1""",
    "failed_work": cte("pairs") + f""", p as (select conv_id from conversations group by 1 having max(turn) % 4 = 0),
      t as (select *, {duck.strip('src')} as s, {duck.strip('tgt')} as t from pairs), u as (select *, upper(trim(s, ' ''"¡¿!?.,;:~-_()')) as z from t)
      select doc_id, seq from u where s <> '' and s = t and not {REPAIR} and doc_id not in (select conv_id from p)""",
    "failed_pages": STATUS + "select run, status, count(*) as n from failed where bad group by 1, 2",
    "compare_runs": LATEST + """, d as (select coalesce(a.page, b.page) as page, a.n_blocks as a_n_blocks, a.n_translated as a_n_translated, a.status as a_status,
        b.n_blocks as b_n_blocks, b.n_translated as b_n_translated, b.status as b_status,
        case when b.page is null then 'only_a' when a.page is null then 'only_b'
          when (a.n_blocks, a.n_translated, a.status) is distinct from (b.n_blocks, b.n_translated, b.status) then 'changed' end as change
        from (select * from last where run = 'A') a full join (select * from last where run = 'B') b on a.page = b.page)
      select * from d where change is not null""",
    "changed_texts": cte("blocks") + """select coalesce(a.page_id, c.page_id) as page, count(*) as changed_texts from (select * from blocks where engine = 0) a
      full join (select * from blocks where engine = 2) c on a.page_id = c.page_id and a.i = c.i where (a.text, a.type) is distinct from (c.text, c.type) or a.page_id is null or c.page_id is null group by 1""",
    "metric_deltas": STATUS + f""", s as (select *, {RATE} from (select run, {STATS_SQL} from failed group by run)),
      l as (unpivot (select run, {', '.join(c + '::double as ' + c for c in r.STATS)}, translation_rate from s) on columns(* exclude run) into name metric value v)
      select metric, max(v) filter (run = 'A') as a, max(v) filter (run = 'B') as b, max(v) filter (run = 'B') - max(v) filter (run = 'A') as delta from l group by metric""",
    "ab_effect": TRIAL + """, t as (select count(*) as pages, count(*) filter (c) as controls, count(*) filter (st > 0) as affected,
        coalesce(sum(d) filter (c) / count(*) filter (c) / 100, 0) as drift_mean, coalesce(max(abs(d)) filter (c) / 100, 0) as drift_max,
        coalesce(sum(d) filter (st > 0) / count(*) filter (st > 0) / 100, 0) as effect, sum(bcs) / count(*) / 100 as avg_base, sum(acs) / count(*) / 100 as avg_alt,
        sum(bb)::bigint as blocks_base, sum(ab)::bigint as blocks_alt from ok)
      select *, case when controls = 0 then 'no_controls' when abs(drift_mean) <= greatest(0.10, avg_base * 0.04) and drift_max <= greatest(0.10, avg_base * 0.04) then 'stable'
        when abs(effect) > drift_max then 'cautious' else 'inconclusive' end as verdict from t""",
    "latency_report": cte("page_runs") + """, t as (select run, status_raw = 'done' as ok, round(elapsed_s, 2) as t, cast(round(elapsed_s * 100) as bigint) as cs from page_runs)
      select run, count(*) as total, count(*) filter (ok) as success, count(*) filter (not ok) as errors, round(sum(cs) filter (ok) / count(*) filter (ok) / 100, 6) as mean,
        min(t) filter (ok) as min, round(quantile_cont(t, 0.25) filter (ok), 6) as p25, round(quantile_cont(t, 0.5) filter (ok), 6) as median, round(quantile_cont(t, 0.75) filter (ok), 6) as p75,
        round(quantile_cont(t, 0.9) filter (ok), 6) as p90, max(t) filter (ok) as max, count(*) filter (ok and t > 200) as over_limit from t group by run""",
    "latency_histogram": cte("page_runs") + "select cast(floor(elapsed_s / 25) * 25 as bigint) as bucket, count(*) as n from page_runs group by 1",
    "memory_growth": """with g as (select arg_min(value, ts) as before, arg_max(value, ts) as after, count(*) filter (event_type = 'error') as errors from events)
      select *, after - before as growth, errors > 0 or after - before > 100 as leak from g""",
    "production_summary": """with t as (select *, cast(round(value * 100) as bigint) as cs, event_id % 4 = 0 as trig, event_id % 8 = 0 as vlm, event_id % 20 = 4 as salv from events)
      select count(*) as pages, sum(cs) / 100 as total_s, sum(cs) / count(*) / 100 as avg_s, sum(event_id % 9)::bigint as blocks, count(*) filter (trig) as triggers, count(*) filter (vlm) as vlm_calls,
        sum(case when event_id % 16 = 0 then 2 else 0 end)::bigint as recovered, count(*) filter (salv) as salvaged, count(*) filter (trig and not salv and not vlm) as negative_skips,
        count(*) filter (event_id % 3 > 0) as yolo_pages, count(*) filter (event_id % 5 > 0) as ctd_pages from t""",
    "stage_share": """with t as (select cast(round(value * 100) as bigint) as cs from events), u as (select cs, cast(floor(cs * 6 / 10) as bigint) as d from t),
      s as (select 'detect' as stage, sum(d) as c, count(*) as pages from u union all select 'recognise', sum(cs - d), count(*) from u),
      p as (select stage, c / 100 as seconds, pages, c * 100.0::double / (select sum(c) from s) as share_pct from s)
      select *, case when share_pct > 60 then 'dominates' when share_pct < 40 then 'minor' else 'balanced' end as role from p""",
    "mode_summary": cte("page_runs") + """, t as (select *, cast(round(elapsed_s * 100) as bigint) as cs from page_runs)
      select status_raw as mode, count(*) as pages, sum(cs) / 100 as total_s, sum(cs) / count(*) / 100 as mean_s, sum(n_blocks)::bigint as blocks, sum(n_blocks) / count(*) as mean_blocks, count(*) filter (n_blocks = 0) as errors from t group by 1""",
    "with_and_without": cte("page_runs") + """, t as (select *, cast(round(elapsed_s * 100) as bigint) as cs, run = 'A' as step from page_runs),
      u as (select page, sum(n_blocks) filter (step)::bigint as blocks_with, sum(n_blocks) filter (not step)::bigint as blocks_without, sum(cs) filter (step) / 100 as seconds_with, sum(cs) filter (not step) / 100 as seconds_without from t group by page)
      select * from u where blocks_with is not null and blocks_without is not null""",
    "metric_gate": """with c as (select source as name, count(*) filter (lang = 'en') * 100.0::double / count(*) as value from documents group by 1),
      l as (select source as name, 55.0::double + min(doc_id) % 10 as threshold from documents where doc_id % 20 <> 7 group by 1),
      b as (select source as name, sum(quality) * 100.0::double / count(*) as base_value from documents join labels using (doc_id) group by 1),
      s as (select distinct source as name, true as f from documents where lang = 'es')
      select name, value, threshold, base_value, coalesce(f, false) as in_scope, case when threshold is null then case when coalesce(f, false) then 'FAIL' else 'SKIP' end
        when value < threshold - 0.05 and coalesce(f, false) then 'FAIL' when value < threshold - 0.05 then 'WARN' else 'OK' end as verdict, value - base_value as delta
      from c left join l using (name) left join b using (name) left join s using (name)""",
    "round_history": """with d as (select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as score from events group by 1, 2)
      select event_type, day, score, score - lag(score) over w as step, score - first_value(score) over w as since_first from d window w as (partition by event_type order by day)""",
    "share_batch_time": cte("batch_results") + """, n as (select batch_id, count(*) as n from batch_results group by 1), g as (select * from batch_results where event_type <> 'error'),
      s as (select batch_id, max(batch_elapsed_s) as s from g group by 1)
      select b.batch_id, b.page, s / n as elapsed_s, case when g.page is null then 'missing_result' when g.event_type <> 'view' then 'done' else 'bad_result' end as status
      from batch_results b join n using (batch_id) left join s using (batch_id) left join g on g.batch_id = b.batch_id and g.page = b.page""",
    "make_batches": """with k as (select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 4 as batch from events)
      select user_id, batch, count(*) as n, min(event_id) as first_id from k group by 1, 2""",
    "sample_pages": LIBRARY,
    "training_set": """select split, count(*) as n from (select case when doc_id % 5 = 0 then 'val' else 'train' end as split from documents union all select 'train' from pages) group by 1""",
    "split_check": """select s as split, count(d) as n, count(d) > 0 as ok from (values ('train'), ('val')) v(s) left join (select case when lang = 'en' then 'train' else 'extra' end as d from documents) on s = d group by 1""",
    "text_sets": cte("blocks") + """, m as (select page_id, text, bool_or(engine = 0) as a, bool_or(engine = 1) as b from blocks where engine in (0, 1) group by 1, 2)
      select page_id, count(*) filter (a and not b) as only_base, count(*) filter (b and not a) as only_alt, count(*) filter (a and b) as both from m group by 1""",
    "compact_ranges": """select event_type, min(event_id) as first, max(event_id) as last from (select event_type, event_id, event_id - row_number() over (partition by event_type order by event_id) as g from events where event_type <> 'error') group by event_type, g""",
    "range_text": cte("blocks") + """, r as (select page_id, min(i) as f, max(i) as l from (select page_id, i, i - row_number() over (partition by page_id order by i) as g from blocks where engine = 2) group by page_id, g)
      select page_id, string_agg(case when f = l then cast(f as varchar) else f || '-' || l end, ', ' order by f) as ranges from r group by 1""",
    "union_sources": cte("blocks") + "select case engine when 0 then 'easyocr' else 'rapid' end as source, count(*) as n, sum(length(text))::bigint as chars from blocks where engine in (0, 1) group by 1",
    "updated_first": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as updated from orders order by updated desc, o_orderkey",
}
