"""Streaming jobs run to completion over the events table."""

import uuid

from pyspark.sql import functions as F

from blockflow.fixtures import _BOTH, cte
from blockflow.session import shared_dir
from blockflow.streaming import jobs, state


def stream_of(fx, name):
    """A derived input as a stream over the events file."""
    schema = fx.events.schema
    events = (fx.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(fx.sf_dir))
    return fx.spark.sql(_BOTH[name], events=events) if name != "events" else events


def done(fx, stream):
    return jobs.run_to_table(stream, f"{shared_dir(fx.spark)}/stream-{uuid.uuid4().hex}")


def attempts(fx):
    return (stream_of(fx, "page_runs").withColumn("attempt", F.lit(0))
            .withColumn("error", F.when(F.col("status_raw") != "done", F.col("status_raw"))))


def start_us(df):
    return df.withColumn("window_start", F.unix_micros("window_start"))


def closed(column: str, length: str, delay: str) -> str:
    """Windows that end before the final watermark."""
    return f"{column} + interval '{length}' <= (select max(ts) - interval '{delay}' from events)"


QUERIES = {
    "stream_page_stats": lambda fx: start_us(done(fx, jobs.page_stats(attempts(fx)))),
    "stream_rate_counts": lambda fx: start_us(done(fx, jobs.rate_counts(
        stream_of(fx, "calls"), limit=1))),
    "stream_log_counts": lambda fx: start_us(done(fx, jobs.log_counts(
        stream_of(fx, "log_lines")))),
    "stream_first_requests": lambda fx: done(fx, jobs.first_requests(stream_of(
        fx, "page_stream"), ["doc_id", "signature"])).groupBy("doc_id", "signature").agg(
        F.count("*").alias("n")),
    "stream_liveness": lambda fx: done(fx, jobs.liveness(
        stream_of(fx, "calls"), ["client"], "6 hours")).withColumn(
        "alive_from", F.unix_micros("alive_from")),
    "stream_memory": lambda fx: done(fx, state.learn_stream(stream_of(fx, "memory_events"))),
    "stream_streaks": lambda fx: done(fx, state.streak_stream(stream_of(fx, "calls"), 20.0)),
    "stream_incremental": lambda fx: done(fx, stream_of(fx, "page_runs").where(
        "status_raw = 'done'")).groupBy("run").agg(F.count("*").alias("n")),
}

ORACLES = {
    "stream_page_stats": cte("page_runs") + f""", t as (select *, status_raw <> 'done' as bad, date_trunc('hour', ts) as w from page_runs)
      select epoch_us(w) as window_start, count(*) as pages, count(*) filter (bad) as pages_error, count(*) filter (not bad and n_blocks = 0) as pages_empty,
        sum(case when not bad then n_blocks else 0 end)::bigint as blocks, sum(case when not bad then n_translated else 0 end)::bigint as translated from t where {closed('w', '1 hour', '10 minutes')} group by w""",
    "stream_rate_counts": f"""with t as (select user_id as client, date_trunc('hour', ts) as w from events) select client, epoch_us(w) as window_start, count(*) as calls, greatest(0, count(*) - 1) as refused from t where {closed('w', '1 hour', '1 hour')} group by client, w""",
    "stream_log_counts": cte("log_lines") + f""", c as (select case when starts_with(line, '[google] Error') then 'ENGINE_ERROR' when starts_with(line, '[translate] Cache HIT:') then 'CACHE_HIT' when starts_with(line, '[process-page]') then 'OCR_VACIO' when starts_with(line, '[google] Texto') then 'GOOGLE_UNCHANGED_COUNT' end as category, time_bucket(interval '30 minutes', ts) as b from log_lines),
      w as (select category, unnest([b, b - interval '30 minutes']) as w from c where category is not null)
      select category, epoch_us(w) as window_start, count(*) as n from w where w + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events where event_type <> 'view') group by 1, w""",
    "stream_streaks": cte("calls") + """, f as (select *, n_blocks = 0 and elapsed_s < 20 as fast, sum(case when n_blocks > 0 then 1 else 0 end) over (partition by client order by ts, event_id) as g from calls),
      r as (select *, sum(case when fast then 1 else 0 end) over (partition by client, g order by ts, event_id) as streak from f) select client, event_id, streak::bigint as streak, fast and streak >= 3 as alarm from r""",
    "stream_incremental": cte("page_runs") + "select run, count(*) as n from page_runs where status_raw = 'done' group by 1",
}
