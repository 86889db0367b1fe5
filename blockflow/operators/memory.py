"""Translation memory and caches: learning, lookup, eviction, resolution."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockflow.functions import text as tx
from blockflow.operators import language as la
from blockflow.operators import scan
from blockflow.operators import texts as te
from blockflow.rules import effects as ef
from blockflow.rules import glossary as gl
from blockflow.session import checkpointed

DAY = 86_400.0
KEYS = ["doc_id", "source_key", "source_lang", "target_lang"]


def seconds(ts: Column) -> Column:
    """Event time as epoch seconds."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def memory_key(c: Column) -> Column:
    """Blanks collapsed, case folded (Latin and East Asian text keeps its glyphs)."""
    return tx.casefold(tx.collapse(c))


def _lang(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def learnable(events: DataFrame, min_quality: float = 0.65) -> DataFrame:
    """Events that may change the memory: not blank, not a copy, good enough."""
    e = (events.withColumn("source_key", memory_key(F.col("source")))
         .withColumn("translation", tx.collapse(F.col("translation")))
         .withColumn("_target", memory_key(F.col("translation")))
         .withColumn("source_lang", _lang("source_lang"))
         .withColumn("target_lang", _lang("target_lang"))
         .withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("quality")))))
    return e.where((F.col("source_key") != "") & (F.col("_target") != "")
                   & (F.col("source_key") != F.col("_target"))
                   & (F.col("quality") >= min_quality))


def learn_memory(events: DataFrame, min_quality: float = 0.65, margin: float = 0.12,
                 slice_s: int = 3600) -> DataFrame:
    """Memory entries out of learning events (doc_id, source, translation, source_lang,
    target_lang, quality, ts, event_id).

    Per key in time order: the same target raises the quality to its maximum; another target
    replaces the entry only at ``margin`` better, which restarts the count; anything else just
    counts.

    A hot key is not folded whole. The quality of an entry never falls, so an event whose
    target was seen before at the same or a higher quality can neither replace nor raise:
    only the first event of each new maximum per (key, target) can change the entry. These
    records are found with a sliced scan and are the only rows that reach the fold. How often
    the entry was confirmed is then a plain count of events since the last replacement, and
    the first and last sighting are a minimum and a maximum, all with map-side combine.
    """
    e = learnable(events, min_quality).withColumn("_t", seconds(F.col("ts")))
    e = e.withColumn("_slice", F.floor(F.col("_t") / slice_s))
    order = ["_t", "event_id"]
    scanned = scan.earlier_max(e, [*KEYS, "_target"], order, "_slice", F.col("quality"), "_best")
    records = scanned.where(F.col("_best").isNull() | (F.col("quality") > F.col("_best")))
    item = F.struct(F.col("_t").alias("t"), F.col("event_id").alias("id"),
                    F.col("_target").alias("target"), F.col("translation").alias("shown"),
                    F.col("quality").alias("q"))
    start = F.struct(F.lit(None).cast("double").alias("t"), F.lit(None).cast("bigint").alias("id"),
                     F.lit(None).cast("string").alias("target"),
                     F.lit(None).cast("string").alias("shown"), F.lit(-1.0).alias("q"))

    def step(acc: Column, x: Column) -> Column:
        raised = F.struct(acc["t"].alias("t"), acc["id"].alias("id"), acc["target"].alias("target"),
                          acc["shown"].alias("shown"), F.greatest(acc["q"], x["q"]).alias("q"))
        return (F.when(acc["target"].isNull(), x).when(acc["target"] == x["target"], raised)
                .when(x["q"] >= acc["q"] + margin, x).otherwise(acc))

    entry = (records.groupBy(*KEYS).agg(F.aggregate(
        F.array_sort(F.collect_list(item)), start, step).alias("_e"))
        .select(*KEYS, F.col("_e.t").alias("_since"), F.col("_e.id").alias("_since_id"),
                F.col("_e.shown").alias("translation"), F.col("_e.q").alias("quality")))
    later = (F.struct("_t", "event_id") >= F.struct(F.col("_since").alias("_t"),
                                                    F.col("_since_id").alias("event_id")))
    counted = (e.select(*KEYS, "source", "_t", "event_id").join(entry, KEYS).groupBy(*KEYS).agg(
        F.first("translation").alias("translation"), F.first("quality").alias("quality"),
        F.min_by(tx.collapse(F.col("source")), F.struct("_t", "event_id")).alias("source"),
        F.count_if(later).alias("occurrences"), F.min("_t").alias("first_seen"),
        F.max("_t").alias("last_seen")))
    return counted


def memory_lookup(requests: DataFrame, memory: DataFrame, now: float,
                  ttl_s: float = 30 * DAY) -> DataFrame:
    """Exact key in the scope of the document, within the time limit; null on a miss.

    Requests (doc_id, text, source_lang, target_lang) may repeat one term very often: the
    distinct keys meet the memory, and the answers go back to all rows.
    """
    keyed = (requests.withColumn("source_key", memory_key(F.col("text")))
             .withColumn("source_lang", _lang("source_lang"))
             .withColumn("target_lang", _lang("target_lang")))
    alive = memory.where(now - F.col("last_seen") <= ttl_s)
    answers = (keyed.select(*KEYS).distinct()
               .join(alive.select(*KEYS, F.col("translation").alias("memory_result")), KEYS))
    return keyed.join(answers, KEYS, "left").drop("source_key")


def _neighbours(c: Column) -> Column:
    """Keys on which two terms one edit apart meet, each key for exactly one kind of edit.

    A replaced glyph leaves equal strings once its place is blanked; an extra glyph leaves the
    shorter term once it is taken out.
    """
    places = F.sequence(F.lit(1), F.length(c))

    def without(k: Column, fill: str) -> Column:
        return F.concat(F.substr(c, F.lit(1), k - 1), F.lit(fill), F.substr(c, k + 1))

    return F.concat(F.transform(places, lambda k: F.concat(F.lit("r"), without(k, "\x00"))),
                    F.transform(places, lambda k: F.concat(F.lit("d"), without(k, ""))),
                    F.array(F.concat(F.lit("d"), c)))


def memory_lookup_variant(requests: DataFrame, memory: DataFrame, now: float,
                          ttl_s: float = 30 * DAY, min_seen: int = 2,
                          min_quality: float = 0.90) -> DataFrame:
    """Short East Asian terms one edit away from exactly one trusted entry; null otherwise.

    Both sides are exploded into their neighbour keys. The memory side is reduced to one row
    per key (the two extreme entries are enough to tell one from many), so no pairs are made
    within a key however many terms share it.
    """
    keyed = (requests.withColumn("term", memory_key(F.col("text")))
             .withColumn("source_lang", _lang("source_lang"))
             .withColumn("target_lang", _lang("target_lang")))
    scope = ["doc_id", "source_lang", "target_lang"]
    trusted = memory.where((now - F.col("last_seen") <= ttl_s) & (F.col("occurrences") >= min_seen)
                           & (F.col("quality") >= min_quality)
                           & la.is_cjk_term(F.col("source_key")))
    entry = F.struct("source_key", "translation")
    # 'd' keys relate a term with a shortened one: mark which of the two a key comes from
    sides = (trusted.select(*scope, entry.alias("entry"), "source_key",
                            F.explode(F.array_distinct(_neighbours(F.col("source_key"))))
                            .alias("key"))
             .withColumn("whole", F.col("key") == F.concat(F.lit("d"), F.col("source_key")))
             .groupBy(*scope, "key", "whole")
             .agg(F.min("entry").alias("low"), F.max("entry").alias("high")))
    terms = keyed.where(la.is_cjk_term(F.col("term"))).select(*scope, "term").distinct()
    asked = (terms.withColumn("key", F.explode(F.array_distinct(_neighbours(F.col("term")))))
             .withColumn("whole", F.col("key") == F.concat(F.lit("d"), F.col("term"))))
    side = sides.withColumnRenamed("whole", "e_whole")
    met = (asked.join(side, [*scope, "key"])
           .where(F.col("key").startswith("r") | (F.col("whole") != F.col("e_whole"))))
    found = (met.select(*scope, "term", F.explode(F.array("low", "high")).alias("entry"))
             .where(F.col("entry.source_key") != F.col("term"))
             .groupBy(*scope, "term").agg(F.min("entry").alias("low"), F.max("entry").alias("high"))
             .where(F.col("low.source_key") == F.col("high.source_key"))
             .select(*scope, "term", F.col("low.source_key").alias("variant_of"),
                     F.col("low.translation").alias("variant_result")))
    return keyed.join(found, [*scope, "term"], "left").drop("term")


def cache_key(text: Column, src: Column, tgt: Column) -> Column:
    """Null, which meets no entry, where the text or a language is null."""
    return F.md5(F.concat(tx.collapse(text), F.lit("||"), F.lower(tx.strip(src)), F.lit("||"),
                          F.lower(tx.strip(tgt))))


def cache_lookup(requests: DataFrame, cache: DataFrame, now: float, ttl_s: float = 7 * DAY,
                 order: tuple[str, ...] = ("result",)) -> DataFrame:
    """Cached result (cache: text, src, tgt, result, ts) by key, within the time limit.

    The newest entry of a key answers; of equally new ones the first by the columns ``order``.
    """
    newest = F.struct((-F.col("ts")).alias("_age"), *order)
    stored = (cache.where(now - F.col("ts") <= ttl_s)
              .withColumn("cache_key", cache_key(F.col("text"), F.col("src"), F.col("tgt")))
              .groupBy("cache_key").agg(F.min_by("result", newest).alias("cache_result")))
    keyed = requests.withColumn("cache_key", cache_key(
        F.col("text"), F.col("source_lang"), F.col("target_lang")))
    answers = keyed.select("cache_key").distinct().join(stored, "cache_key")
    return keyed.join(answers, "cache_key", "left")


def evict(entries: DataFrame, keep: int, scope: list[str], now: float, ttl_s: float,
          last_seen: str = "last_seen", tie: str = "source_key", shards: int = 64) -> DataFrame:
    """Entries within the time limit, the newest ``keep`` per scope.

    The limit is the operator's own. A first cut inside shards of each scope leaves at most
    shards × keep rows for the final rank, so a scope of any size is never ranked whole.
    """
    alive = (entries.where(now - F.col(last_seen) <= ttl_s)
             .withColumn("_shard", F.pmod(F.xxhash64(tie), F.lit(shards))))
    newest = [F.desc(last_seen), tie]
    part = Window.partitionBy(*scope, "_shard").orderBy(*newest)
    first = alive.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= keep)
    final = Window.partitionBy(*scope).orderBy(*newest)
    return (first.withColumn("_k", F.row_number().over(final)).where(F.col("_k") <= keep)
            .drop("_k", "_shard"))


def distinct_requests(blocks: DataFrame, target: str) -> DataFrame:
    """One request per (collapsed text, language, target, type), best confidence kept."""
    kind = F.lower(tx.strip(F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("text"))))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return (blocks.select(tx.collapse(F.col("text")).alias("request"), "lang",
                          F.lit(target).alias("target_lang"), kind.alias("kind"),
                          conf.alias("confidence"))
            .where(F.col("request") != "").groupBy("request", "lang", "target_lang", "kind")
            .agg(F.max("confidence").alias("confidence"), F.count("*").alias("n")))


def scatter_back(rows: DataFrame, results: DataFrame, text: str = "text") -> DataFrame:
    """Results (request, result) of distinct texts back to every row; the text on a miss."""
    keyed = rows.withColumn("request", tx.collapse(F.col(text)))
    return (keyed.join(results.select("request", "result"), "request", "left")
            .withColumn("result", F.coalesce("result", F.col(text))).drop("request"))


def page_dedup(requests: DataFrame, content: str, params: list[str], arrival: str) -> DataFrame:
    """Marks later requests of the same content and parameters (``repeat``), with the id of the
    first, which gives the result. First arrivals come from a combined ``min``."""
    key = F.sha2(F.concat_ws("\x1f", content, *[F.coalesce(F.col(p).cast("string"), F.lit(""))
                                                for p in params]), 256)
    keyed = requests.withColumn("page_key", key)
    firsts = keyed.groupBy("page_key").agg(F.min(arrival).alias("first_request"))
    return keyed.join(firsts, "page_key").withColumn(
        "repeat", F.col(arrival) != F.col("first_request"))


def alive_intervals(touches: DataFrame, keys: list[str], ttl_s: float,
                    slice_s: int = 86_400) -> DataFrame:
    """Spans in which an entry stayed alive: touches less than ``ttl_s`` apart."""
    t = (touches.withColumn("_t", seconds(F.col("ts")))
         .withColumn("_slice", F.floor(F.col("_t") / slice_s)))
    t = checkpointed(scan.previous(t, keys, ["_t"], "_slice", F.col("_t"), "_before"))
    fresh = F.when(F.col("_before").isNull() | (F.col("_t") - F.col("_before") > ttl_s),
                   F.col("_t"))
    t = scan.latest(t, keys, ["_t"], "_slice", fresh, "alive_from")
    return t.groupBy(*keys, "alive_from").agg(F.max("_t").alias("last_touch"),
                                              F.count("*").alias("touches"))


# --- resolution ------------------------------------------------------------------------------

def accepted_result(source: Column, result: Column, source_lang: Column,
                    target_lang: Column) -> Column:
    """A candidate that passes the gates, else null."""
    ok = (tx.is_valid_translation(source, result)
          & ~tx.is_source_leftover(F.coalesce(result, F.lit("")), source_lang, target_lang))
    return F.when(ok, result)


def resolve_translation(df: DataFrame) -> DataFrame:
    """``result`` and ``method`` from candidate columns, best source first.

    ``df``: text, source_lang, target_lang, type, confidence, is_mixed, and candidates
    memory_result, variant_result, cache_result, mixed_result, primary_result,
    fallback_result, pivot_result (null where there is none). Each candidate is gated once, in
    its own projection; then one ``coalesce`` and one parallel ``when``.
    """
    text, src, tgt = F.col("_text"), F.col("source_lang"), F.col("target_lang")
    kind = F.lower(F.coalesce("type", F.lit("")))
    effect = tx.is_effect_translator(tx.strip(F.col("text"))) & ~kind.isin(
        ef.SPOKEN_TYPES)
    base = (df.withColumn("_effect", effect | (kind == "sfx"))
            .withColumn("_clean", tx.strip_symbols(F.col("text")))
            .withColumn("_text", F.when(src.isin("es", "auto"), tx.apply_rules(
                F.col("_clean"), gl.BEFORE)).otherwise(F.col("_clean"))))
    gated = base.withColumns({
        "_memory": accepted_result(text, F.col("memory_result"), src, tgt),
        "_variant": F.when(F.col("confidence") >= 0.75, accepted_result(
            text, F.col("variant_result"), src, tgt)),
        "_cache": accepted_result(text, F.col("cache_result"), src, tgt),
        "_mixed": F.when(F.col("is_mixed"), accepted_result(
            text, F.col("mixed_result"), src, tgt)),
        "_primary": accepted_result(text, F.col("primary_result"), src, tgt),
        "_noise": ~src.isin("ja", "ko", "zh") & tx.is_noise_translator(text),
        "_fallback": accepted_result(text, F.col("fallback_result"), src, tgt),
        "_pivot": F.when((tgt == "es") & src.isin("ja", "ko", "zh"), accepted_result(
            text, F.col("pivot_result"), src, tgt)),
    })

    steps = [("effect", F.col("_effect"), F.col("text")),
             ("blank", text == "", F.lit("")),
             *[(name, F.col("_" + name).isNotNull(), F.col("_" + name))
               for name in ("memory", "variant", "cache", "mixed")],
             ("same_language", src == tgt, text),
             ("primary", F.col("_primary").isNotNull(), F.col("_primary")),
             ("noise", F.col("_noise"), text),
             ("fallback", F.col("_fallback").isNotNull(), F.col("_fallback")),
             ("pivot", F.col("_pivot").isNotNull(), F.col("_pivot"))]
    method, raw = None, None
    for name, test, value in steps:
        method = F.when(test, name) if method is None else method.when(test, name)
        raw = F.when(test, value) if raw is None else raw.when(test, value)
    engines = ["mixed", "primary", "fallback", "pivot"]
    return (gated.withColumn("method", method.otherwise("source"))
            .withColumn("result", raw.otherwise(text))
            .withColumn("result", F.when(F.col("method").isin(engines), te.post_process(
                F.col("result"))).otherwise(F.col("result")))
            .withColumn("result", F.when(F.col("method").isin("cache", *engines), te.honorific(
                text, F.col("result"), src)).otherwise(F.col("result")))
            .drop("_effect", "_clean", "_text", "_memory", "_variant", "_cache", "_mixed",
                  "_primary", "_noise", "_fallback", "_pivot"))


def translate_batches(rows: DataFrame, fn: Callable[[list[str], str, str], list[str]],
                      batches_per_pair: int = 32) -> DataFrame:
    """Translate ``text`` (source_lang, target_lang) with a batch function.

    Distinct texts are bucketed by language pair and a hash, so one pair that holds most of
    the corpus still spreads over ``batches_per_pair`` tasks; ``fn(texts, source, target)`` is
    called once per Arrow batch and pair. Results pass the same gates as everywhere and go back
    to all rows; a refused result keeps the text.
    """
    import pandas as pd

    keyed = rows.withColumn("request", tx.collapse(F.col("text")))
    pair = ["source_lang", "target_lang"]
    asked = keyed.where(F.col("request") != "").select("request", *pair).distinct()

    def run(frames):
        for pdf in frames:
            for (src, tgt), group in pdf.groupby(pair, sort=False):
                texts = group["request"].tolist()
                yield pd.DataFrame({"request": texts, "source_lang": src, "target_lang": tgt,
                                    "raw": fn(texts, src, tgt)})

    bucket = F.pmod(F.xxhash64("request"), F.lit(batches_per_pair))
    done = (asked.withColumn("_b", bucket).repartition(*pair, "_b").drop("_b")
            .mapInPandas(run, "request string, source_lang string, target_lang string, raw string")
            .withColumn("result", accepted_result(F.col("request"), F.col("raw"), F.col(
                "source_lang"), F.col("target_lang"))))
    return (keyed.join(done.select("request", *pair, "result"), ["request", *pair], "left")
            .withColumn("result", F.coalesce("result", "text")).drop("request"))
