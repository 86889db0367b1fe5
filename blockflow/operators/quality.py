"""Source/target pairs: categories, reports, consistency, alerts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockflow.functions import text as tx
from blockflow.rules import effects as fx

CATEGORIES = ["EMPTY", "SFX_PRESERVED", "SFX_TRANSLATED", "OCR_NOISY_RECOVERED", "OCR_GARBAGE",
              "NAME_PRESERVED", "ALREADY_TARGET", "UNTRANSLATED", "BAD_TRANSLATION",
              "LITERAL_TRANSLATION", "GOOD_TRANSLATION", "REVIEW_LANGUAGE"]
ACCEPTED = ["SFX_PRESERVED", "SFX_TRANSLATED", "OCR_NOISY_RECOVERED", "NAME_PRESERVED",
            "ALREADY_TARGET", "LITERAL_TRANSLATION", "GOOD_TRANSLATION"]


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """Category, acceptance and reason of each pair (src, tgt, source_lang, target_lang,
    block_type).

    Flags are computed once in their own projection; the category is one ordered ``when`` and
    the reason follows from it.
    """
    src = tx.strip(F.coalesce(F.col("src"), F.lit("")))
    tgt = tx.strip(F.coalesce(F.col("tgt"), F.lit("")))
    kind = F.lower(tx.strip(F.coalesce(F.col("block_type"), F.lit(""))))
    flagged = (
        pairs.withColumn("_s", src).withColumn("_t", tgt)
        .withColumn("_sl", tx.normal_lang(F.col("source_lang")))
        .withColumn("_tl", tx.normal_lang(F.col("target_lang")))
        .withColumns({
            "_same": tx.same_text(F.col("_s"), F.col("_t")),
            "_fx": tx.is_effect_quality(F.col("_s"), kind),
            "_sg": tx.is_noise_quality(F.col("_s")),
            "_tg": tx.is_noise_quality(F.col("_t")),
            "_name": F.replace(kind, F.lit("-"), F.lit("_")).isin(fx.NAME_TYPES),
            "_sw": tx.count_of(F.col("_s"), r"(?U)\w+"),
            "_tw": tx.count_of(F.col("_t"), r"(?U)\w+"),
            "_like": (F.col("_tl") != "auto") & tx.looks_like_language(F.col("_t"), F.col("_tl")),
        }))
    s, t, same = F.col("_s"), F.col("_t"), F.col("_same")
    ratio = F.col("_tw") / F.greatest(F.col("_sw"), F.lit(1))
    own = (F.col("_sl") == F.col("_tl")) & (F.col("_tl") != "auto")
    category = (
        F.when((s == "") & (t == ""), "EMPTY")
        .when(F.col("_fx") & same, "SFX_PRESERVED")
        .when(F.col("_fx") & (t != "") & ~F.col("_tg"), "SFX_TRANSLATED")
        .when(F.col("_sg") & (t != "") & ~same & ~F.col("_tg"), "OCR_NOISY_RECOVERED")
        .when(F.col("_sg"), "OCR_GARBAGE")
        .when(F.col("_name") & same, "NAME_PRESERVED")
        .when(same & (own | tx.looks_like_language(s, F.col("_tl"))), "ALREADY_TARGET")
        .when(same | (t == ""), "UNTRANSLATED")
        .when(F.col("_tg"), "BAD_TRANSLATION")
        .when((F.col("_sw") >= 3) & (F.col("_tw") >= 3) & (ratio > 0.5) & (ratio < 1.5),
              "LITERAL_TRANSLATION")
        .when((F.col("_tl") == "auto") | F.col("_like"), "GOOD_TRANSLATION")
        .otherwise("REVIEW_LANGUAGE"))
    c = F.col("category")
    reason = (
        F.when(c == "EMPTY", "both texts are empty")
        .when(c == "SFX_PRESERVED", "sound effect kept")
        .when(c == "SFX_TRANSLATED", "sound effect translated")
        .when(c == "OCR_NOISY_RECOVERED", "noisy reading recovered")
        .when(c == "OCR_GARBAGE", "source shows strong signs of a bad reading")
        .when(c == "NAME_PRESERVED", "proper name kept")
        .when((c == "ALREADY_TARGET") & own, "source and target language are the same")
        .when(c == "ALREADY_TARGET", "text is already in the target language")
        .when((c == "UNTRANSLATED") & same, "same text without enough context")
        .when(c == "UNTRANSLATED", "empty target")
        .when(c == "BAD_TRANSLATION", "target shows signs of a bad reading")
        .when(c == "LITERAL_TRANSLATION", "comparable length")
        .when(c == "GOOD_TRANSLATION", "target fits the declared language")
        .otherwise("target does not clearly fit the declared language"))
    return (flagged.withColumn("category", category)
            .withColumn("accepted", c.isin(ACCEPTED))
            .withColumn("reason", reason)
            .withColumn("lang_pair", F.concat_ws("→", "_sl", "_tl"))
            .drop("_s", "_t", "_sl", "_tl", "_same", "_fx", "_sg", "_tg", "_name", "_sw", "_tw",
                  "_like"))


def has_metadata() -> Column:
    """Does a pair carry a type or a language of its own?"""
    return F.coalesce(F.col("block_type"), F.lit("")) != ""


def quality_report(pairs: DataFrame) -> DataFrame:
    """Totals, acceptance and category counts per language pair and overall.

    One map-side combined aggregation; the overall row comes from ``rollup``.
    """
    classified = classify_pairs(pairs)
    meta = (F.col("has_metadata") if "has_metadata" in pairs.columns else has_metadata())
    counts = [F.count_if(F.col("category") == c).alias(c.lower()) for c in CATEGORIES]
    return (classified.rollup("lang_pair")
            .agg(F.grouping("lang_pair").alias("_all"), F.count("*").alias("total"),
                 F.count_if("accepted").alias("accepted_n"),
                 F.count_if(meta).alias("with_metadata"), *counts)
            .withColumn("lang_pair", F.when(F.col("_all") == 1, "ALL")
                        .otherwise(F.col("lang_pair")))
            .withColumn("acceptance_rate", F.col("accepted_n") * 100.0 / F.col("total"))
            .withColumn("metadata_coverage", F.col("with_metadata") / F.col("total"))
            .drop("_all"))


VARIANT_KEYS = ["lang_pair", "kind", "source_key"]


def translation_variants(pairs: DataFrame) -> DataFrame:
    """One row per source and way it was translated, with how often: (lang_pair, kind, source_key,
    target, source, n). The whole table, also of sources with one translation."""
    src, tgt = F.col("src"), F.col("tgt")
    kind = F.lower(tx.strip(F.coalesce(F.col("block_type"), F.lit(""))))
    usable = (classify_pairs(pairs)
              .where((F.coalesce(src, F.lit("")) != "") & (F.coalesce(tgt, F.lit("")) != "")
                     & ~F.col("category").isin("OCR_GARBAGE", "EMPTY"))
              .where(~tx.is_effect_quality(src, kind))
              .select("lang_pair", kind.alias("kind"),
                      tx.casefold(tx.collapse(src)).alias("source_key"),
                      tx.strip(src).alias("source"), tx.strip(tgt).alias("target")))
    return usable.groupBy(*VARIANT_KEYS, "target").agg(F.min("source").alias("source"),
                                                       F.count("*").alias("n"))


def consistency_conflicts(pairs: DataFrame) -> DataFrame:
    """Sources of one pair and type that were translated in more than one way.

    Distinct (key, target) first, so that a source repeated a million times reaches the second
    aggregation as its variants; ``targets`` holds every one of them, in alphabetical order.
    """
    return (translation_variants(pairs).groupBy(*VARIANT_KEYS)
            .agg(F.min("source").alias("source"),
                 F.count_distinct(tx.casefold(F.col("target"))).alias("n_targets"),
                 F.array_sort(F.collect_set("target")).alias("targets"))
            .where("n_targets > 1"))


# --- alerts ----------------------------------------------------------------------------------

# Alerts that make a page critical.
CRITICAL_ALERTS = ["OCR_BASURA", "BASURA", "IDENTICO", "VACIO", "TEXTO_REPETITIVO",
                   "FALLO_TRADUCCION"]
# Contractions and their words; applied in this order. Fixed values.
CONTRACTIONS = [
    ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"),
    ("'m", " am"), ("that's", "that is"), ("there's", "there is"), ("it's", "it is"),
    ("he's", "he is"), ("she's", "she is"), ("what's", "what is"), ("let's", "let us"),
]


def english_words(c: Column) -> Column:
    t = F.lower(c)
    for short, full in CONTRACTIONS:
        t = F.replace(t, F.lit(short), F.lit(full))
    return F.filter(F.transform(tx.words(t), lambda w: tx.strip_chars(w, ".,;:!?\"'()[]{}*")),
                    lambda w: w != "")


def _alerts(flags) -> Column:
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in flags]),
                    lambda a: a.isNotNull())


def block_alerts(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Ten alerts per pair; ``lexicon`` (word) says what counts as an English word.

    Word hits are counted by exploding the distinct words of each target and joining the
    lexicon, so the lexicon may be of any size. ``pairs`` needs a unique ``pair_id``.
    """
    base = (pairs.withColumn("_s", F.coalesce(F.col("src"), F.lit("")))
            .withColumn("_t", F.coalesce(F.col("tgt"), F.lit("")))
            .withColumn("_conf", F.coalesce(F.col("confidence"), F.lit(1.0)))
            .withColumn("_w", english_words(F.col("_t"))))
    hits = (base.select("pair_id", F.explode("_w").alias("word"))
            .groupBy("pair_id", "word").agg(F.count("*").alias("n"))
            .join(lexicon.select("word").distinct(), "word", "left_semi")
            .groupBy("pair_id").agg(F.sum("n").alias("_hits")))
    b = base.join(hits, "pair_id", "left").withColumn("_hits", F.coalesce("_hits", F.lit(0)))
    s, t, n_words = F.col("_s"), F.col("_t"), F.size("_w")
    ns, nt = F.length(s), F.length(t)
    english = ((nt < 4) | (n_words == 0)
               | F.when(n_words <= 3, F.col("_hits") >= 1)
               .otherwise(F.col("_hits") >= n_words * 0.25))
    same = (s != "") & (t != "") & (tx.strip(s) == tx.strip(t))
    both = (s != "") & (t != "") & (ns > 5)
    b = b.withColumn("_en", english)
    en = F.col("_en")
    return (b.withColumn("alerts", _alerts([
        ("VACIO", (t == "") | (F.length(tx.strip(t)) < 2)),
        ("IDENTICO", same & ~en),
        ("CONFIANZA_BAJA", same & en & (F.col("_conf") < 0.30) & (ns > 3)),
        ("DEMASIADO_CORTO", both & (nt < ns * 0.2)),
        ("DEMASIADO_LARGO", both & (nt > ns * 8)),
        ("POSIBLE_NO_TRADUCIDO", both & (F.abs(nt - ns) < 3) & (tx.strip(t) != tx.strip(s)) & ~en),
        ("BASURA", (t != "") & (tx.count_of(t, r"[\[\]`~^<>{}|\\]") > nt * 0.25)),
        ("OCR_BASURA", tx.is_noise_manager(s)),
        ("NO_INGLES", (nt > 3) & ~t.contains("[!]") & ~en & (n_words >= 3)),
        ("TEXTO_REPETITIVO", (nt > 4) & (F.size(F.array_distinct(F.filter(
            F.split(F.lower(t), ""), lambda x: x != ""))) <= 3)),
    ])).drop("_s", "_t", "_conf", "_w", "_hits", "_en"))


def block_flags(pairs: DataFrame) -> DataFrame:
    """Six simple flags per pair."""
    s, t = F.coalesce(F.col("src"), F.lit("")), F.coalesce(F.col("tgt"), F.lit(""))
    return pairs.withColumn("flags", _alerts([
        ("IDENTICO", s == t),
        ("VACIO", (t == "") | (F.length(tx.strip(t)) < 2)),
        ("CORTO", F.length(t) < F.length(s) * 0.2),
        ("LARGO", F.length(t) > F.length(s) * 5),
        ("ENCODING_ROTO", t.contains("�")),
        ("GARBAGE", tx.count_of(t, r"[\[\]`~^<>{}|\\]") > F.length(t) * 0.3),
    ]))


def page_health(pages: DataFrame, alerts: DataFrame) -> DataFrame:
    """Health, alert counts and retry need of each page (page_id, http_status), worst first.

    ``alerts`` is (page_id, alerts array). Counted per (page, alert) before the page rows are
    put together, so a huge page sends counts and not texts.
    """
    blocks = alerts.groupBy("page_id").agg(F.count("*").alias("n_blocks"))
    kinds = (alerts.select("page_id", F.explode("alerts").alias("alert"))
             .groupBy("page_id", "alert").agg(F.count("*").alias("n"))
             .groupBy("page_id")
             .agg(F.sum("n").alias("n_alerts"),
                  F.array_sort(F.collect_set("alert")).alias("alert_kinds"),
                  F.max(F.col("alert").isin(CRITICAL_ALERTS)).alias("_critical")))
    joined = (pages.join(blocks, "page_id", "left").join(kinds, "page_id", "left")
              .withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
              .withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0)))
              .withColumn("alert_kinds", F.coalesce("alert_kinds",
                                                    F.array().cast("array<string>"))))
    health = (F.when(F.col("http_status") == 0, "ERROR")
              .when(F.col("http_status") != 200, "ERROR_HTTP")
              .when(F.col("n_alerts") > 0, "ALERTAS")
              .when(F.col("n_blocks") == 0, "SIN_TEXTO").otherwise("OK"))
    return (joined.withColumn("health", health)
            .withColumn("retry", F.col("health").isin("ERROR", "ERROR_HTTP")
                        | ((F.col("health") == "ALERTAS")
                           & F.coalesce(F.col("_critical"), F.lit(False))))
            .drop("_critical").orderBy(F.desc("n_alerts"), "page_id"))
