"""Pair quality over ``pairs``."""

from pyspark.sql import functions as F

from blockflow.catalog import duck
from blockflow.catalog.duck import sql_in
from blockflow.fixtures import cte
from blockflow.operators import quality as q
from blockflow.rules import effects as ef


# Pairs with every flag of the classification; all targets are English in this input.
FLAGGED = cte("pairs") + f"""
, base as (select *, {duck.strip("coalesce(src,'')")} as s, {duck.strip("coalesce(tgt,'')")} as t,
    case source_lang when 'spa' then 'es' else source_lang end as sl, target_lang as tl
  from pairs),
flags as (select *, {duck.bare('s')} = {duck.bare('t')} as same,
    lower(trim(s, ' ''!?.,;:~-_()[]{{}}')) as bare,
    {duck.garbage('s')} as sg, {duck.garbage('t')} as tg,
    len(regexp_extract_all(s, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) as sw,
    len(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) as tw,
    {duck.has_common('t','en')} as likes_t, {duck.has_common('s','en')} as likes_s
  from base),
fx as (select *, (bare <> '' and length(bare) <= 20 and (bare in {sql_in(ef.KNOWN_EFFECTS)}
    or {duck.triple('bare')} or (starts_with(bare,'*') and ends_with(bare,'*')))) as is_fx from flags),
classified as (select doc_id, seq, src, tgt, s, t, block_type, sl || '→' || tl as lang_pair, is_fx,
  case when s = '' and t = '' then 'EMPTY'
    when is_fx and same then 'SFX_PRESERVED'
    when is_fx and t <> '' and not tg then 'SFX_TRANSLATED'
    when sg and t <> '' and not same and not tg then 'OCR_NOISY_RECOVERED'
    when sg then 'OCR_GARBAGE'
    when same and (sl = tl or likes_s) then 'ALREADY_TARGET'
    when same or t = '' then 'UNTRANSLATED'
    when tg then 'BAD_TRANSLATION'
    when sw >= 3 and tw >= 3 and tw / greatest(sw,1) > 0.5 and tw / greatest(sw,1) < 1.5 then 'LITERAL_TRANSLATION'
    when likes_t then 'GOOD_TRANSLATION' else 'REVIEW_LANGUAGE' end as category
  from fx)
"""
ACCEPTED = f"category in {sql_in(q.ACCEPTED)}"

# An English lexicon made from the corpus: words that five English documents hold.
LEXICON_SQL = r"""lexicon as (select word from (select distinct doc_id, unnest(string_split(
  regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) as word from documents where lang = 'en')
  where word <> '' group by word having count(*) >= 5)"""


def lexicon(fx):
    """Words that at least five English documents hold."""
    words = (fx.documents.where("lang = 'en'").select("doc_id", F.explode(F.split(
        F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")).alias("word"))
        .where("word <> ''").distinct())
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 5").select("word")


def alert_input(fx):
    return fx.pairs.withColumn("pair_id", F.col("doc_id") * 1000 + F.col("seq")).withColumn(
        "confidence", (F.col("seq") % 10) / 10.0)


EXPANDED = "lower(tgt)"
for _short, _full in q.CONTRACTIONS:
    EXPANDED = "replace(" + EXPANDED + ", '" + _short.replace("'", "''") + f"', '{_full}')"

ALERTS = cte("pairs") + f""", {LEXICON_SQL},
base as (select *, doc_id * 1000 + seq as pair_id, (seq % 10) / 10.0 as confidence,
   {duck.strip('src')} as s, {duck.strip('tgt')} as t from pairs),
tokens as (select pair_id, unnest(list_filter(list_transform(string_split_regex({duck.strip(EXPANDED)}, '\\s+'),
   lambda w: trim(w, '.,;:!?"''()[]{{}}*')), lambda w: w <> '')) as word from base),
counted as (select pair_id, count(*) as n_words, count(*) filter (word in (select word from lexicon)) as hits from tokens group by pair_id),
judged as (select b.*, coalesce(n_words,0) as nw, length(tgt) < 4 or coalesce(n_words,0) = 0 or
   (case when n_words <= 3 then hits >= 1 else hits >= n_words * 0.25 end) as en
   from base b left join counted using (pair_id)),
flips as (select pair_id, len(list_filter(range(2, length(s)+1), lambda k: regexp_matches(substr(s,k,1),'\\p{{L}}') and regexp_matches(substr(s,k-1,1),'\\p{{L}}')
    and regexp_matches(substr(s,k,1),'\\p{{Lu}}') <> regexp_matches(substr(s,k-1,1),'\\p{{Lu}}'))) as n_flips,
    len(regexp_extract_all(s,'\\p{{L}}')) as letters from base),
alerts as (select doc_id, seq, list_filter([
   case when length(t) < 2 then 'VACIO' end,
   case when s <> '' and t <> '' and s = t and not en then 'IDENTICO' end,
   case when s <> '' and t <> '' and s = t and en and confidence < 0.3 and length(src) > 3 then 'CONFIANZA_BAJA' end,
   case when src <> '' and tgt <> '' and length(src) > 5 and length(tgt) < length(src) * 0.2 then 'DEMASIADO_CORTO' end,
   case when src <> '' and tgt <> '' and length(src) > 5 and length(tgt) > length(src) * 8 then 'DEMASIADO_LARGO' end,
   case when src <> '' and tgt <> '' and length(src) > 5 and abs(length(tgt) - length(src)) < 3 and s <> t and not en then 'POSIBLE_NO_TRADUCIDO' end,
   case when tgt <> '' and len(regexp_extract_all(tgt, '[\\[\\]`~^<>{{}}|\\\\]')) > length(tgt) * 0.25 then 'BASURA' end,
   case when length(s) >= 3 and (letters / length(s) < 0.35 or (letters >= 4 and regexp_matches(s,'\\p{{Lu}}') and regexp_matches(s,'\\p{{Ll}}') and n_flips > length(s) * 0.35)) then 'OCR_BASURA' end,
   case when length(tgt) > 3 and not contains(tgt,'[!]') and not en and nw >= 3 then 'NO_INGLES' end,
   case when length(tgt) > 4 and len(list_distinct(string_split(lower(tgt),''))) <= 3 then 'TEXTO_REPETITIVO' end],
   lambda a: a is not null) as alerts from judged join flips using (pair_id))
"""

QUERIES = {
    "classify_pairs": lambda fx: q.classify_pairs(fx.pairs).select(
        "doc_id", "seq", "category", "accepted", "lang_pair"),
    "quality_report": lambda fx: q.quality_report(fx.pairs),
    "consistency_conflicts": lambda fx: q.consistency_conflicts(fx.told_twice).select(
        "lang_pair", "kind", "source_key", "n_targets", F.array_join("targets", "|")
        .alias("targets")),
    "block_alerts": lambda fx: q.block_alerts(alert_input(fx), lexicon(fx)).select(
        "doc_id", "seq", F.array_join("alerts", ",").alias("alerts")),
    "block_flags": lambda fx: q.block_flags(fx.pairs).select(
        "doc_id", "seq", F.array_join("flags", ",").alias("flags")),
    "page_health": lambda fx: q.page_health(
        fx.conversations.groupBy(F.col("conv_id").alias("page_id")).agg(
            F.when(F.max("turn") % 7 == 0, 500).otherwise(200).alias("http_status")),
        q.block_alerts(alert_input(fx), lexicon(fx)).select(
            F.col("doc_id").alias("page_id"), "alerts")).withColumn(
        "alert_kinds", F.array_join("alert_kinds", ",")),
}

ORACLES = {
    "classify_pairs": FLAGGED + f"""select doc_id, seq, category, {ACCEPTED} as accepted, lang_pair from classified""",
    "quality_report": FLAGGED + f"""select case when grouping(lang_pair) = 1 then 'ALL' else lang_pair end as lang_pair,
      count(*) as total, count(*) filter ({ACCEPTED}) as accepted_n,
      count(*) filter (coalesce(block_type,'') <> '') as with_metadata,
      {', '.join(f"count(*) filter (category = '{c}') as {c.lower()}" for c in q.CATEGORIES)},
      count(*) filter ({ACCEPTED}) * 100.0::double / count(*) as acceptance_rate,
      count(*) filter (coalesce(block_type,'') <> '') / count(*) as metadata_coverage
      from classified group by rollup(lang_pair)""",
    "consistency_conflicts": FLAGGED.replace("from pairs)", "from told_twice)").replace(
        cte("pairs"), cte("told_twice")) + f""", v as (
        select lang_pair, lower(coalesce(block_type,'')) as kind,
          {duck.fold(duck.collapse('s'))} as source_key, t from classified
        where src <> '' and tgt <> '' and not is_fx and category not in ('OCR_GARBAGE','EMPTY'))
      select lang_pair, kind, source_key, count(distinct {duck.fold('t')}) as n_targets,
        array_to_string(list_sort(list(distinct t)), '|') as targets
      from v group by all having count(distinct {duck.fold('t')}) > 1""",
    "block_alerts": ALERTS + "select doc_id, seq, array_to_string(alerts, ',') as alerts from alerts",
    "block_flags": cte("pairs") + f"""select doc_id, seq, array_to_string(list_filter([
      case when src = tgt then 'IDENTICO' end,
      case when length({duck.strip('tgt')}) < 2 then 'VACIO' end,
      case when length(tgt) < length(src) * 0.2 then 'CORTO' end,
      case when length(tgt) > length(src) * 5 then 'LARGO' end,
      case when contains(tgt, chr(65533)) then 'ENCODING_ROTO' end,
      case when len(regexp_extract_all(tgt, '[\\[\\]`~^<>{{}}|\\\\]')) > length(tgt) * 0.3 then 'GARBAGE' end],
      lambda a: a is not null), ',') as flags from pairs""",
    "page_health": ALERTS + f""", pages_ as (select conv_id as page_id, case when max(turn) % 7 = 0 then 500 else 200 end as http_status from conversations group by 1),
      nb as (select doc_id as page_id, count(*) as n_blocks from alerts group by 1),
      kinds as (select page_id, count(*) as n_alerts, array_to_string(list_sort(list(distinct a)), ',') as alert_kinds,
         bool_or(a in {sql_in(q.CRITICAL_ALERTS)}) as critical from (select doc_id as page_id, unnest(alerts) as a from alerts) group by 1),
      j as (select page_id, http_status, coalesce(n_blocks,0) as n_blocks, coalesce(n_alerts,0) as n_alerts, coalesce(alert_kinds,'') as alert_kinds, coalesce(critical,false) as critical
         from pages_ left join nb using (page_id) left join kinds using (page_id)),
      h as (select *, case when http_status = 0 then 'ERROR' when http_status <> 200 then 'ERROR_HTTP' when n_alerts > 0 then 'ALERTAS' when n_blocks = 0 then 'SIN_TEXTO' else 'OK' end as health from j)
      select page_id, http_status, n_blocks, n_alerts, alert_kinds, health,
        health in ('ERROR','ERROR_HTTP') or (health = 'ALERTAS' and critical) as retry from h""",
}
