"""Text jobs over a corpus: cleaning, glossaries, keys, validation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockflow.functions import text as tx
from blockflow.rules import glossary as gl
from blockflow.rules import languages as lg


def apply_glossary(df: DataFrame, rules=None, text: str = "text", out: str = "text") -> DataFrame:
    """Ordered substitutions; ``rules`` is a list of (pattern, replacement)."""
    return df.withColumn(out, tx.apply_rules(F.col(text), gl.BEFORE if rules is None else rules))


def strip_symbols(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop reading symbols; marked effects such as ``*sigh*`` keep theirs."""
    c = F.col(text)
    return df.withColumn(text, F.when(tx.is_effect_translator(c), tx.strip(c)).otherwise(
        tx.strip_symbols(c)))


def is_all_caps(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}") & (F.length(c) > 1)


def caps_query(df: DataFrame, text: str = "text") -> DataFrame:
    """All-capitals texts are asked for in title case (``query``, ``all_caps``)."""
    caps = is_all_caps(F.col(text))
    return df.withColumn("all_caps", caps).withColumn(
        "query", F.when(caps, F.initcap(F.lower(text))).otherwise(F.col(text)))


def caps_restore(df: DataFrame, result: str = "result") -> DataFrame:
    """Answers to all-capitals texts go back to capitals."""
    return df.withColumn(result, F.when(F.col("all_caps"), F.upper(result)).otherwise(
        F.col(result)))


def post_process(c: Column) -> Column:
    """Blanks collapsed and the first letter raised, unless the text is an effect."""
    t = F.regexp_replace(tx.strip(c), r"(?U)\s{2,}", " ")
    raised = F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))
    lower_first = F.substring(t, 1, 1).rlike(r"^\p{Ll}") & (tx.strip(F.substr(t, F.lit(2))) != "")
    return F.when(lower_first & ~tx.is_effect_translator(t), raised).otherwise(t)


def post_process_translation(df: DataFrame, text: str = "result") -> DataFrame:
    return df.withColumn(text, post_process(F.col(text)))


def honorific(original: Column, translated: Column, source_lang: Column) -> Column:
    """Translation with the romanised honorific of an isolated name."""
    lang = F.lower(F.trim(F.coalesce(source_lang, F.lit(""))))
    out = None
    for code, table in lg.HONORIFICS.items():
        # longer suffixes first, so that one suffix cannot hide another
        names = sorted(table, key=len, reverse=True)
        suffix = F.regexp_extract(
            tx.strip(original), f"^{lg.HONORIFIC_NAME[code]}\\s*({'|'.join(names)})$", 1)
        mark = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        romanised = F.try_element_at(mark, suffix)
        titled = suffix.isin(lg.TITLED_HONORIFICS) & translated.rlike(lg.TITLE_WORDS)
        value = (F.when(romanised.isNull() | (tx.strip(translated) == "")
                        | F.contains(F.lower(translated), romanised) | titled, translated)
                 .otherwise(F.concat(F.regexp_replace(translated, r"(?U)\s+$", ""), romanised)))
        test = lang.isin("ja", "ja-jp") if code == "ja" else lang == code
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(translated)


def keep_honorifics(df: DataFrame) -> DataFrame:
    """(src, result, source_lang) → ``result`` with honorifics kept."""
    return df.withColumn("result", honorific(F.col("src"), F.col("result"), F.col("source_lang")))


def keep_name_or_effect(df: DataFrame) -> DataFrame:
    """``kept``: an effect, or one capitalised word that came back in title case."""
    src, tgt = tx.strip(F.coalesce("src", F.lit(""))), tx.strip(F.coalesce("tgt", F.lit("")))
    name = ((tx.casefold(src) == tx.casefold(tgt)) & (tx.word_count(src) == 1)
            & src.rlike(r"\p{Lu}") & ~src.rlike(r"\p{Ll}")
            & tgt.rlike(r"^[A-ZÀ-Ý][a-zà-ÿ]{2,}$"))
    typed = F.lower(tx.strip(F.coalesce("block_type", F.lit("")))) == "sfx"
    return df.withColumn("kept", typed | name)


def tag_effects(df: DataFrame, rule_set: str = "translator", text: str = "text",
                kind: str | None = None) -> DataFrame:
    """``effect`` by one of three rule sets: translator, quality, repair."""
    c = F.col(text)
    tests = {"translator": lambda: tx.is_effect_translator(c),
             "quality": lambda: tx.is_effect_quality(c, F.col(kind) if kind else F.lit("")),
             "repair": lambda: tx.is_effect_repair(c)}
    return df.withColumn("effect", tests[rule_set]())


def tag_ocr_noise(df: DataFrame, rule_set: str = "translator", text: str = "text") -> DataFrame:
    """``noise`` by one of three models: translator, quality, manager."""
    tests = {"translator": tx.is_noise_translator, "quality": tx.is_noise_quality,
             "manager": tx.is_noise_manager}
    return df.withColumn("noise", tests[rule_set](F.col(text)))


def tag_valid_translation(df: DataFrame, rule_set: str = "current") -> DataFrame:
    test = (tx.is_valid_translation if rule_set == "current"
            else tx.is_valid_translation_offline)
    return df.withColumn("valid", test(F.col("src"), F.col("tgt")))


def tag_target_language(df: DataFrame, text: str = "tgt", lang: str = "target_lang") -> DataFrame:
    return df.withColumn("looks_right", tx.looks_like_language(
        F.coalesce(F.col(text), F.lit("")), tx.normal_lang(F.col(lang))))


def tag_source_leftover(df: DataFrame) -> DataFrame:
    return df.withColumn("leftover", tx.is_source_leftover(
        F.coalesce(F.col("tgt"), F.lit("")), F.col("source_lang"), F.col("target_lang")))


def normalize_text(df: DataFrame, form: str = "plain", text: str = "text",
                   out: str = "normal") -> DataFrame:
    """``plain`` (lower, no accents, ASCII), ``markup`` (plain without markup) or ``key``
    (blanks collapsed, case folded)."""
    forms = {"plain": tx.plain_latin, "markup": tx.comparable,
             "key": lambda c: tx.casefold(tx.collapse(c))}
    return df.withColumn(out, forms[form](F.col(text)))


# --- requests --------------------------------------------------------------------------------

def validate_requests(df: DataFrame, max_chars: int = 20_000, max_words: int = 5_000,
                      max_batch: int = 500) -> DataFrame:
    """``error`` code per request (batch_id, text, source_lang, target_lang), null when valid.

    Batch sizes come from an aggregation joined back, not from a window over a whole batch.
    """
    sizes = df.groupBy("batch_id").agg(F.count("*").alias("_n"))
    src = F.lower(F.trim(F.coalesce("source_lang", F.lit("auto"))))
    tgt = F.lower(F.trim(F.coalesce("target_lang", F.lit("es"))))
    text = F.coalesce(F.col("text"), F.lit(""))
    error = (F.when(F.col("_n") > max_batch, "batch_too_large")
             .when(tx.strip(text) == "", "blank")
             .when(~src.isin(lg.SUPPORTED), "bad_source")
             .when(~tgt.isin([c for c in lg.SUPPORTED if c != "auto"]), "bad_target")
             .when((src != "auto") & (src == tgt), "same_language")
             .when(F.length(text) > max_chars, "too_long")
             .when(tx.word_count(text) > max_words, "too_many_words"))
    return df.join(sizes, "batch_id").withColumn("error", error).drop("_n")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, quarantine)."""
    return (checked.where(F.col("error").isNull()).drop("error"),
            checked.where(F.col("error").isNotNull()))


def flag(c: Column, default: bool = False) -> Column:
    """Booleans written as 0/1 or yes/no words."""
    token = F.lower(tx.strip(c.cast("string")))
    return (F.when(token.isin("true", "1", "yes", "on"), True)
            .when(token.isin("false", "0", "no", "off", ""), False).otherwise(F.lit(default)))


def coerce_flags(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    return df.withColumns({c: flag(F.col(c), default) for c, default in columns.items()})


def document_keys(df: DataFrame, name: str = "name", scope: str = "scope",
                  signature: str = "signature") -> DataFrame:
    """Hashes of the file name (whole, and short to display), a sanitised scope, and the scoped
    signature."""
    clean = F.substring(F.regexp_replace(F.coalesce(F.col(scope), F.lit("")), "[^A-Za-z0-9_]", ""),
                        1, 64)
    sig = F.coalesce(F.col(signature), F.lit(""))
    return (df.withColumn("doc_md5", F.md5(name)).withColumn("doc_sha256", F.sha2(F.col(name), 256))
            .withColumn("doc_key", F.substring(F.md5(name), 1, 12))
            .withColumn("doc_key_sha", F.substring(F.sha2(F.col(name), 256), 1, 12))
            .withColumn("clean_scope", clean)
            .withColumn("scoped_signature", F.when((clean == "") | (sig == ""), sig)
                        .otherwise(F.concat_ws(":", clean, sig))))


def natural_key(c: Column) -> Column:
    """Sort key in which digit runs of any length compare as numbers: the number of digits
    goes before them."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))

    def numbered(p: Column) -> Column:
        digits = F.ltrim(p, F.lit("0"))
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), numbered(p))
                                    .otherwise(p)), "")


def natural_sort_key(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("sort_key", natural_key(F.col(name)))


def page_range(pages: DataFrame, spec: str, page: str = "page") -> DataFrame:
    """Pages of ``A-B`` or ``A``; blank keeps all; anything else is refused."""
    if not spec:
        return pages
    first, _, last = spec.partition("-")
    try:
        a = int(first)
        b = int(last) if last else a
    except ValueError:
        raise ValueError(f"page range {spec!r} is not A-B") from None
    return pages.where(F.col(page).between(max(a, 1), max(b, a)))
