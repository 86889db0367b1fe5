"""Inputs derived from the given tables, once for Spark and once for DuckDB.

Every derivation covers whole tables and whole texts. ``Fixtures(spark, dir).blocks`` is a
DataFrame; ``cte("blocks")`` is the matching ``with`` clause for an oracle query.
"""

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

WIDTH = 100  # characters of a document that one text line of a page holds

_SPARK_ONLY = {
    "lines": f"""
        select doc_id, cast(pos as bigint) as i, line as text from (
          select doc_id, posexplode_outer(
              regexp_extract_all(text, '[^\\n]{{{{1,{WIDTH}}}}}+', 0)) as (pos, line)
          from {{documents}}) where pos is not null""",
    "grids": """
        select vec_id, label as doc_id, transform(embedding, v -> if(v > 0, 1, 0)) as cells
        from {embeddings}""",
    "words": """
        select word, count(*) as freq from (
          select explode(split(regexp_replace(lower(text),
            '[^a-zàâäçèéêëîïñóôöùúûüáíß]+', ' '), ' ')) as word from {documents})
        where length(word) >= 2 group by word""",
}
_DUCK_ONLY = {
    "lines": f"""
        select doc_id, cast(i as bigint) as i, line as text from (
          select doc_id, unnest(range(len(p))) as i, unnest(p) as line from (
            select doc_id, list_filter(flatten(list_transform(string_split(text, chr(10)),
              lambda s: list_transform(range(0, greatest(1, (length(s) + {WIDTH} - 1) // {WIDTH})),
                lambda k: substr(s, cast(k * {WIDTH} + 1 as integer), {WIDTH})))),
              lambda x: length(x) > 0) as p
            from documents))""",
    "grids": """
        select vec_id, label as doc_id,
          list_transform(embedding, lambda v: case when v > 0 then 1 else 0 end) as cells
        from embeddings""",
    "words": """
        select word, count(*) as freq from (
          select unnest(string_split(regexp_replace(lower(text),
            '[^a-zàâäçèéêëîïñóôöùúûüáíß]+', ' ', 'g'), ' ')) as word from documents)
        where length(word) >= 2 group by word""",
}
_BOTH = {
    # Three engines read the same page: engine 1 misreads e as c, engine 2 misses a third of the
    # lines, boxes shift by a few pixels.
    "blocks": """
        select doc_id as page_id, i * 3 + e as block_id, i, e as engine,
          (doc_id*37 + i*113) % 700 + e*3 as x, i*29 + e*2 as y,
          least(420, length(text)*7) as w, 14 + (i % 4)*3 as h,
          case when e = 1 then replace(text,'e','c') else text end as text,
          cast(((doc_id*31 + i*17 + e*13) % 100)/100.0 as double) as confidence,
          case when i = 0 then 'chapter_title' when i % 5 = 1 then 'caption'
               when i % 5 = 2 then 'speech-bubble' else 'text' end as type
        from {lines} cross join (select 0 as e union all select 1 union all select 2) g
        where not (e = 2 and (doc_id + i) % 3 = 0)""",
    "page_sizes": """
        select page_id, cast(1130 as bigint) as page_w, max(y + h) + 29 as page_h
        from {blocks} group by page_id""",
    "pairs": """
        select a.conv_id as doc_id, a.turn as seq,
          case (a.conv_id + a.turn) % 3 when 0 then 'es' when 1 then 'spa' else 'auto' end
            as source_lang,
          'en' as target_lang, a.text as src,
          case when (a.conv_id*7 + a.turn) % 5 = 0 then a.text
               when (a.conv_id*7 + a.turn) % 11 = 0 then '' else b.text end as tgt,
          case when a.turn % 4 = 0 then 'dialogue' else null end as block_type
        from {conversations} a join {conversations} b
          on a.conv_id = b.conv_id and b.turn = a.turn + 1
        where a.role = 'user' and b.role = 'assistant'""",
    "retold": """
        select doc_id, seq, source_lang, target_lang,
          concat('told again for the ', cast(doc_id % 40 as varchar(8)), 'th time') as src,
          case when seq % 3 = 0 then concat('contada ', cast(doc_id % 7 as varchar(8)), ' veces')
               else tgt end as tgt, block_type
        from {pairs}""",
    # All pairs as they are, and once more with few sources, so that some are told differently.
    "told_twice": "select * from {pairs} union all select * from {retold}",
    "page_runs": """
        select event_id, ts, event_id % 60 as page,
          case when event_type in ('click','purchase') then 'A' else 'B' end as run,
          case event_type when 'error' then 'timeout' when 'signup' then 'http_500'
               else 'done' end as status_raw,
          event_id % 9 as n_blocks,
          least(event_id % 9, event_id % 7) as n_translated,
          value as elapsed_s
        from {events}""",
    "calls": """
        select event_id, ts, user_id as client, event_type = 'error' as unchanged,
          case when event_type in ('error','view') then 0 else event_id % 6 end as n_blocks,
          value as elapsed_s
        from {events}""",
    "memory_events": """
        select event_id, ts, user_id % 4 as doc_id,
          translate(cast(100 + user_id % 40 as varchar(8)),'0123456789','田中口黒崎先生様山川')
            as source,
          concat('name-', cast((event_id*7 + user_id) % 3 as varchar(8))) as translation,
          'ja' as source_lang, 'es' as target_lang,
          cast((event_id*37 % 101)/100.0 as double) as quality
        from {events}""",
    "gold": """
        select page_id, i as gold_id, i % 2 as cls, x, y, w, h from {blocks} where engine = 0""",
    "dets": """
        select page_id, i as det_id, i % 2 as cls, x, y, w, h, confidence
        from {blocks} where engine = 2""",
    "regions": """
        select page_id, i as region_id, x, y, w, h,
          case i % 4 when 0 then 'text_free' when 1 then 'speech_bubble' when 2 then 'text_bubble'
               else 'person' end as label
        from {blocks} where engine = 2""",
    "log_lines": """
        select event_id, cast(user_id % 3 as varchar(8)) as file, ts,
          case event_type when 'error' then '[google] Error: timeout'
            when 'view' then concat('[translate] src_lang=es, target=en, text=''frase ',
                                    cast(user_id as varchar(8)), '''')
            when 'click' then '[translate] Cache HIT: ok'
            when 'signup' then '[process-page] OCR (fusion): 0 bloques'
            else concat('[google] Texto sin cambios (', cast(event_id % 3 + 1 as varchar(8)),
                        '/3)') end as line
        from {events}""",
    # One elapsed time per batch of four pages.
    "batch_results": """
        select event_id as page, cast(floor(event_id / 4) as bigint) as batch_id,
          value as batch_elapsed_s, event_type
        from {events}""",
    # Pages in arrival order with what the fast engines saw, for the decision caches.
    "page_stream": """
        select event_id, ts, user_id % 4 as doc_id,
          concat('sig', cast(user_id % 25 as varchar(8))) as signature,
          cast(event_id % 7 as bigint) as n_blocks,
          cast((event_id*37 % 101)/100.0 as double) as avg_conf,
          event_id % 11 = 0 as big_panel, event_type = 'purchase' as gained
        from {events}""",
}
_DEPENDS = {
    "lines": ["documents"], "grids": ["embeddings"], "words": ["documents"],
    "blocks": ["lines"], "page_sizes": ["blocks"], "pairs": ["conversations"],
    "page_runs": ["events"], "calls": ["events"], "memory_events": ["events"],
    "gold": ["blocks"], "dets": ["blocks"], "regions": ["blocks"], "log_lines": ["events"],
    "batch_results": ["events"], "page_stream": ["events"], "retold": ["pairs"],
    "told_twice": ["pairs", "retold"],
}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Long texts in a file too small to be split keep one core busy: spread them over all.

    A table whose scan already has a partition per core is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


class Fixtures:
    """Given tables and derived inputs of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            table = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
            return spread(table, "doc_id") if name == "documents" else table
        sql = _SPARK_ONLY.get(name) or _BOTH[name]
        return self.spark.sql(sql, **{d: getattr(self, d) for d in _DEPENDS[name]})


def cte(*names: str) -> str:
    """``with`` clause defining the named inputs, and what they depend on, for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for d in _DEPENDS[name]:
            visit(d)
        order.append(name)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        sql = _DUCK_ONLY.get(n) or _BOTH[n].format(**{d: d for d in _DEPENDS[n]})
        parts.append(f"{n} as ({sql})")
    return "with " + ",\n".join(parts) + "\n"
