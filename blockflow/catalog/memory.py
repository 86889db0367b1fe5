"""Translation memory, caches and spelling over the given tables."""

from pyspark.sql import functions as F

from blockflow.catalog import duck
from blockflow.catalog.texts import first_words
from blockflow.fixtures import cte
from blockflow.functions import text as tx
from blockflow.operators import memory as m
from blockflow.operators import spelling as sp

NOW = 1706745600.0  # 2024-02-01, shortly after the last event
now = NOW


def memory(fx):
    """Entries with times and counts straight from the events, one per key."""
    return (fx.memory_events.groupBy("doc_id", F.col("source").alias("source_key"), "source_lang",
                                     "target_lang")
            .agg(F.max("translation").alias("translation"), F.count("*").alias("occurrences"),
                 F.max("quality").alias("quality"),
                 F.max(m.seconds(F.col("ts"))).alias("last_seen")))


MEMORY = cte("memory_events") + """, mem as (select doc_id, source as source_key, max(translation) as translation, count(*) as occurrences, max(quality) as quality, max(epoch_us(ts)) / 1000000 as last_seen from memory_events group by doc_id, source)
"""


def asked(fx):
    """Requests: known terms, terms with a replaced, lost or extra glyph, and spaces."""
    term = F.col("source")
    n = F.col("event_id") % 5
    text = (F.when(n == 0, F.concat(F.lit(" "), term)).when(n == 1, F.concat(F.substring(term, 1, 2), F.lit("村")))
            .when(n == 2, F.substring(term, 1, 2)).when(n == 3, F.concat(term, F.lit("村"))).otherwise(term))
    return fx.memory_events.select("event_id", "doc_id", text.alias("text"), F.lit("JA")
                                   .alias("source_lang"), F.lit("es").alias("target_lang"))


ASKED = """, asked as (select event_id, doc_id, case event_id % 5 when 0 then source when 1 then substr(source, 1, 2) || '村' when 2 then substr(source, 1, 2) when 3 then source || '村' else source end as term from memory_events)
"""


def variant_memory(fx):
    """Part of the terms, so that some requests have one neighbour only."""
    return memory(fx).where(F.substring("source_key", 2, 1).isin("田", "口"))


def cached(fx):
    return fx.pairs.where("tgt <> ''").select(
        F.col("src").alias("text"), F.lit("es").alias("src"), "target_lang",
        F.col("tgt").alias("result"), (F.lit(NOW) - F.col("doc_id") % 12 * 86400).alias("ts"),
        "doc_id", "seq").withColumnRenamed("target_lang", "tgt")


def block_requests(fx):
    return fx.blocks.where("engine < 2").select(
        "page_id", "block_id", "text", F.lit("es").alias("lang"), "type", "confidence")


def candidates(fx):
    """Pairs with every kind of candidate on some of the rows."""
    k = F.col("doc_id") + F.col("seq")
    tgt = F.col("tgt")

    def some(mod, at, value=tgt):
        return F.when(k % mod == at, value)

    return fx.pairs.select(
        "doc_id", "seq", F.col("src").alias("text"), F.lit("fr").alias("source_lang"),
        "target_lang", F.col("block_type").alias("type"), ((k % 10) / 10.0).alias("confidence"),
        (k % 3 == 0).alias("is_mixed"), some(7, 1).alias("memory_result"),
        some(5, 1).alias("variant_result"), some(6, 2).alias("cache_result"),
        some(3, 0).alias("mixed_result"), some(4, 3).alias("primary_result"),
        some(2, 0).alias("fallback_result"), F.lit(None).cast("string").alias("pivot_result"))


def reversed_words(texts, src, tgt):
    """Stand-in for a translation engine."""
    return [" ".join(reversed(t.split())) for t in texts]


def misread(fx):
    """Words with an e read as c, as the second engine does."""
    return fx.words.select(F.replace("word", F.lit("e"), F.lit("c")).alias("word")).where(
        F.length("word") >= 3).distinct()


def dictionary(fx):
    return fx.words.where("freq >= 3")


DICT = cte("words") + """, dict as (select * from words where freq >= 3), mis as (select distinct replace(word, 'e', 'c') as word from words where length(word) >= 3)
"""


def language_words(fx):
    """(lang, word): words that three documents of a language hold."""
    w = tx.exploded(fx.documents, ["doc_id", "lang"], F.array_distinct(F.split(F.regexp_replace(
        F.lower("text"), r"[^\p{L}]+", " "), " ")), "word").where("word <> ''").distinct()
    return w.groupBy("lang", "word").agg(F.count("*").alias("n")).where("n >= 3").select(
        "lang", "word")


def typed_pairs(fx):
    w = first_words(fx).select(F.lower("text").alias("a")).distinct().where("length(a) >= 4")
    return w.select("a", F.concat(F.substring("a", 2, 1), F.substring("a", 1, 1), F.substr(
        "a", F.lit(3), F.length("a") - 3), F.lit("x")).alias("b"))


QUERIES = {
    "learn_memory": lambda fx: m.learn_memory(fx.memory_events),
    "learn_memory_long": lambda fx: m.learn_memory(fx.memory_events.withColumn(
        "source", F.substring("source", 1, 1))),
    "memory_lookup": lambda fx: m.memory_lookup(asked(fx), memory(fx), now, 10 * m.DAY).select(
        "event_id", "memory_result"),
    "memory_lookup_variant": lambda fx: m.memory_lookup_variant(
        asked(fx), variant_memory(fx), now).select("event_id", "variant_of", "variant_result"),
    "cache_lookup": lambda fx: m.cache_lookup(fx.pairs.select(
        "doc_id", "seq", F.concat(F.lit(" "), "src").alias("text"), F.lit("ES ").alias(
            "source_lang"), "target_lang"), cached(fx), now, order=("doc_id", "seq"))
    .select("doc_id", "seq", "cache_result"),
    "evict": lambda fx: m.evict(
        fx.memory_events.select("doc_id", F.col("event_id").alias("source_key"), m.seconds(F.col(
            "ts")).alias("last_seen")), 500, ["doc_id"], now, 20 * m.DAY).select("doc_id",
                                                                              "source_key"),
    "distinct_requests": lambda fx: m.distinct_requests(block_requests(fx), "en"),
    "scatter_back": lambda fx: m.scatter_back(block_requests(fx), m.distinct_requests(
        block_requests(fx).where("type = 'text'"), "en").select(
        "request", F.upper("request").alias("result"))).groupBy("page_id").agg(
        F.count_if(F.col("result") == F.col("text")).alias("unchanged"),
        F.count("*").alias("n")),
    "page_dedup": lambda fx: m.page_dedup(fx.documents.select(
        "doc_id", "text", "lang", F.lit("png").alias("format")), "text", ["lang", "format"],
        "doc_id").select("doc_id", "first_request", "repeat"),
    "alive_intervals": lambda fx: m.alive_intervals(fx.calls, ["client"], 6 * 3600.0).select(
        "client", (F.col("alive_from") * 1000000).cast("bigint").alias("alive_from"),
        (F.col("last_touch") * 1000000).cast("bigint").alias("last_touch"), "touches"),
    "resolve_translation": lambda fx: m.resolve_translation(candidates(fx)).select(
        "doc_id", "seq", "method", "result"),
    "translate_batches": lambda fx: m.translate_batches(fx.pairs.select(
        "doc_id", "seq", F.col("src").alias("text"), "source_lang", "target_lang"),
        reversed_words),
    "dictionary_candidates": lambda fx: sp.dictionary_candidates(
        misread(fx).join(dictionary(fx).select("word"), "word", "left_anti"), dictionary(fx)),
    "edit_distance": lambda fx: sp.edit_distance(typed_pairs(fx), 3),
    "correct_spelling": lambda fx: sp.correct_spelling(
        fx.blocks.where("engine = 1"), dictionary(fx), ["page_id", "block_id"]).where(
        "corrected <> text").select("page_id", "block_id", "corrected"),
    "tag_foreign_tokens": lambda fx: sp.tag_foreign_tokens(
        fx.blocks.where("engine = 0"), language_words(fx), ["page_id", "block_id"]).select(
        "page_id", "block_id", "foreign_token"),
    "best_corrections": lambda fx: sp.best_corrections(misread(fx), dictionary(fx)),
    "edit_budget_report": lambda fx: sp.edit_budget_report(
        sp.best_corrections(misread(fx), dictionary(fx))),
}

def ONE(x: str) -> str:
    """One byte per glyph: DuckDB measures edits in bytes."""
    return f"translate({x}, '田中口黒崎先生様山川村', 'abcdefghijk')"


LETTER = "translate({0}, 'àâäçèéêëîïñóôöùúûüáíß', 'ABCDEFGHIJKLMNOPQRSTUV')"

ORACLES = {
    "memory_lookup": MEMORY + ASKED + f"select event_id, m.translation as memory_result from asked a left join mem m on m.doc_id = a.doc_id and m.source_key = a.term and {NOW}::double - m.last_seen <= 10 * 86400",
    "memory_lookup_variant": MEMORY + ASKED + f""", vm as (select * from mem where substr(source_key, 2, 1) in ('田', '口') and occurrences >= 2 and quality >= 0.90 and {NOW}::double - last_seen <= 30 * 86400),
      hit as (select a.doc_id, a.term, count(*) as n, min(v.source_key) as k, min(v.translation) as t from (select distinct doc_id, term from asked) a join vm v on a.doc_id = v.doc_id and levenshtein({ONE('a.term')}, {ONE('v.source_key')}) = 1 group by 1, 2)
      select event_id, h.k as variant_of, h.t as variant_result from asked a left join hit h on h.doc_id = a.doc_id and h.term = a.term and h.n = 1""",
    "cache_lookup": cte("pairs") + f""", c as (select {duck.collapse('src')} as k, arg_max(tgt, {NOW}::double - doc_id % 12 * 86400) as r, count(*) as n from pairs where tgt <> '' and doc_id % 12 <= 7 group by 1)
      select doc_id, seq, r as cache_result from pairs left join c on k = {duck.collapse('src')}""",
    "evict": cte("memory_events") + f"select doc_id, event_id as source_key from memory_events where {NOW}::double - epoch_us(ts) / 1000000 <= 20 * 86400 qualify row_number() over (partition by doc_id order by ts desc, event_id) <= 500",
    "distinct_requests": cte("blocks") + f"select {duck.collapse('text')} as request, 'es' as lang, 'en' as target_lang, lower(type) as kind, max(confidence) as confidence, count(*) as n from blocks where engine < 2 and {duck.collapse('text')} <> '' group by 1, 4",
    "scatter_back": cte("blocks") + f""", r as (select distinct {duck.collapse('text')} as q from blocks where engine < 2 and type = 'text' and {duck.collapse('text')} <> '')
      select page_id, count(*) filter (case when q is null then text else replace(upper(q), 'ẞ', 'SS') end = text) as unchanged, count(*) as n from (select * from blocks where engine < 2) left join r on q = {duck.collapse('text')} group by 1""",
    "page_dedup": "select doc_id, min(doc_id) over (partition by text, lang) as first_request, doc_id <> min(doc_id) over (partition by text, lang) as repeat from documents",
    "alive_intervals": cte("calls") + """, g as (select client, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by client order by ts) > 6 * 3600 * 1000000::bigint then 1 else 0 end as s from calls),
      h as (select *, sum(s) over (partition by client order by t) as k from g) select client, min(t) as alive_from, max(t) as last_touch, count(*) as touches from h group by client, k""",
    "dictionary_candidates": DICT + f""", unk as (select word, {LETTER.format('word')} as w from mis where word not in (select word from dict)),
      d as (select word, freq, {LETTER.format('word')} as w from dict),
      uk as (select word, w, unnest(list_append(list_transform(range(1, length(w) + 1), lambda k: substr(w, 1, k - 1) || substr(w, k + 1)), w)) as key from unk),
      dk as (select word, freq, w, unnest(list_append(list_transform(range(1, length(w) + 1), lambda k: substr(w, 1, k - 1) || substr(w, k + 1)), w)) as key from d),
      c as (select distinct u.word, v.word as candidate, v.freq, u.w as a, v.w as b from uk u join dk v using (key))
      select word, candidate, freq, damerau_levenshtein(a, b) as dist from c where damerau_levenshtein(a, b) <= 1""",
    "edit_distance": cte("blocks") + r""", fw as (select i, upper(regexp_replace(strip_accents(string_split(trim(text), ' ')[1]), '[^A-Za-z]', '', 'g')) as w from blocks where engine = 0),
      a as (select distinct lower(case i % 3 when 1 then '*' || w || '*' when 2 then w || '!' else w end) as a from fw),
      p as (select a, substr(a, 2, 1) || substr(a, 1, 1) || substr(a, 3, length(a) - 3) || 'x' as b from a where length(a) >= 4)
      select a, b, case when levenshtein(a, b) > 3 then -1 else levenshtein(a, b) end as edits, case when damerau_levenshtein(a, b) <= 2 then damerau_levenshtein(a, b) end as damerau from p""",
    "tag_foreign_tokens": cte("blocks") + r""", lw as (select lang, word from (select distinct doc_id, lang, unnest(string_split(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'), ' ')) as word from documents) where word <> '' group by 1, 2 having count(*) >= 3),
      j as (select word, bool_or(lang = 'es') as home from lw group by 1),
      tok as (select page_id, block_id, regexp_replace(unnest(string_split_regex(text, '\s+')), '^[''".,;:!?¡¿()\[\]{}]+|[''".,;:!?¡¿()\[\]{}]+$', '', 'g') as w from blocks where engine = 0),
      f as (select distinct page_id, block_id from tok join j on lower(w) = word where not home and length(w) > 1 and not regexp_matches(w, '\p{Nd}'))
      select b.page_id, b.block_id, f.page_id is not null as foreign_token from blocks b left join f using (page_id, block_id) where engine = 0""",
}
