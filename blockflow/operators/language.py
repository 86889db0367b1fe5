"""Languages of texts and pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockflow.functions import text as tx
from blockflow.rules import languages as lg

CELLS = 1 << 15  # numbers that stand for n-grams
MOST_LANGUAGES = 64  # profiles that a plan may hold
PUNCTUATION = ".,¡!¿?()[]{}*\"'"
HANZI_SHORT = r"[\x{4e00}-\x{9faf}]"


def word_set(c: Column) -> Column:
    """Distinct lower-case words without punctuation around them."""
    return F.array_distinct(F.transform(
        tx.words(F.lower(c)), lambda w: F.btrim(w, F.lit(PUNCTUATION))))


def _any_in(tokens: Column, words) -> Column:
    """Whether a word of a list is among the tokens; a list of constants is made into a set once,
    where an array is made into one for every row."""
    return F.exists(tokens, lambda w: w.isin(sorted(set(words))))


def _count_in(tokens: Column, words) -> Column:
    """How many of the distinct tokens are in a list of words."""
    return F.size(F.filter(tokens, lambda w: w.isin(sorted(set(words)))))


def _long_verb(w: Column) -> Column:
    """Whether a word goes beyond a Spanish verb ending."""
    ends = lg.SPANISH_VERB_ENDINGS
    starts = "".join(f"[{''.join(sorted({e[i] for e in ends}))}]" for i in range(2))
    ending = f"(?={starts})(?:{'|'.join(ends)})$"  # most places are ruled out by two letters
    return ((w.rlike(ending) & (F.length(w) > 2))
            | (w.endswith("mente") & (F.length(w) > 6)))


def is_simple_language(c: Column, lang: str) -> Column:
    """Whether ``simple_language`` says ``lang``. Spanish comes right after the scripts, so the tests
    behind it are left out."""
    if lang != "es":
        return simple_language(c, word_set(c)) == lang
    words = F.transform(tx.words(F.lower(c)), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    spanish = sorted(set(lg.SPANISH_WORDS))
    return (~(tx.has_hangul(c) | tx.has_kana(c) | c.rlike(HANZI_SHORT))
            & (c.rlike(f"[{lg.SPANISH_MARKS}]")
               | F.exists(words, lambda w: w.isin(spanish) | _long_verb(w))))


def simple_language(c: Column, tokens: Column) -> Column:
    """Script first, then Spanish marks, words and verb endings, then Portuguese words.

    Words are looked at as a set. A word that is nothing but a verb ending speaks for English;
    one that goes beyond it speaks for Spanish and wins.
    """
    def hits(words) -> Column:
        return _any_in(tokens, words)

    long_verb = F.exists(tokens, _long_verb)
    bare_ending = hits(["ar", "er", "ir"])
    pt_n = _count_in(tokens, lg.PORTUGUESE_WORDS)
    return (F.when(tx.has_hangul(c), "ko").when(tx.has_kana(c), "ja")
            .when(c.rlike(HANZI_SHORT), "zh").when(c.rlike(f"[{lg.SPANISH_MARKS}]"), "es")
            .when(hits(lg.SPANISH_WORDS), "es").when(long_verb, "es").when(bare_ending, "en")
            .when(pt_n >= 2, "pt").when(hits(lg.PORTUGUESE_DISTINCTIVE), "pt").otherwise("en"))


def tag_language_simple(df: DataFrame, text: str = "text", out: str = "lang_tag") -> DataFrame:
    """The words of a text are made once, in their own projection."""
    return (df.withColumn("_words", word_set(F.col(text)))
            .withColumn(out, simple_language(F.col(text), F.col("_words"))).drop("_words"))


def mixed_languages(c: Column, dominant: Column, tokens: Column) -> Column:
    """Languages with strong evidence in one text, the dominant one first.

    ``tokens`` are distinct. Text, dominant language and marker words are worked out once a text,
    the tests only look at them.
    """
    markers = {w for lists in (lg.MIXED_MARKERS, lg.SINGLE_DISTINCTIVE_MARKERS)
               for ws in lists.values() for w in ws} | set(lg.SINGLE_ENGLISH_MARKERS)
    dom = F.lower(F.trim(dominant))
    dom = (F.when(dom.isin("zh-cn", "zh-tw"), "zh").when(dom.isin(lg.DISABLED), "en")
           .otherwise(dom))
    marked = F.filter(tokens, lambda w: w.isin(sorted(markers)))
    counted = F.transform(F.array(marked), lambda m: F.struct(
        m.alias("words"), *(_count_in(m, ws).alias(k) for k, ws in lg.MIXED_MARKERS.items())))[0]
    once = F.struct(tx.strip(F.coalesce(c, F.lit(""))).alias("text"), dom.alias("dom"),
                    counted.alias("n"))
    return F.transform(F.array(once), lambda x: _ordered(x["text"], x["dom"], x["n"]))[0]


def _ordered(text: Column, dom: Column, n: Column) -> Column:
    """The languages of a text by its dominant one and its marker words, ``n``: words, and how
    many of them each language has."""
    own = None
    for code in lg.MIXED_MARKERS:
        own = F.when(dom == code, n[code]) if own is None else own.when(dom == code, n[code])
    strong = own.otherwise(0) >= 2
    tests = [("ko", tx.has_hangul(text)), ("ja", tx.has_kana(text)),
             ("zh", ~tx.has_kana(text) & tx.has_hanzi(text))]
    tests += [(code, n[code] >= 2) for code in lg.MIXED_MARKERS]
    tests += [("en", (dom != "en") & strong & _any_in(n["words"], lg.SINGLE_ENGLISH_MARKERS))]
    tests += [(code, (dom != code) & strong & _any_in(n["words"], marks))
              for code, marks in lg.SINGLE_DISTINCTIVE_MARKERS.items()]
    tests += [(code, dom == code) for code in lg.ACTIVE]
    found = F.array_distinct(F.filter(
        F.array(*[F.when(test, F.lit(code)) for code, test in tests]), lambda x: x.isNotNull()))

    def ordered(found: Column) -> Column:
        others = F.array_sort(F.array_except(found, F.array(dom)))
        return F.when(F.size(found) <= 1, F.array(dom)).otherwise(
            F.concat(F.array_intersect(F.array(dom), found), others))

    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.array(found), ordered)[0])


def tag_mixed_languages(df: DataFrame, dominant: str, text: str = "text") -> DataFrame:
    """Add ``languages`` (dominant first) and ``mixed``."""
    return (df.withColumn("_words", tx.latin_tokens(tx.strip(F.coalesce(text, F.lit("")))))
            .withColumn("languages", mixed_languages(F.col(text), F.col(dominant),
                                                     F.col("_words")))
            .withColumn("mixed", F.size("languages") > 1).drop("_words"))


def language_profiles(samples: DataFrame, n: int = 3, floor: int = -12000) -> DataFrame:
    """(lang, cell, w): weights of hashed character n-grams per language, learned from (text, lang).

    A weight is the logarithm of the gram's share in its language, in thousandths above ``floor``,
    and never negative, so a gram that a language knows never speaks against it. Counts are
    combined map-side: a task gives at most ``CELLS`` rows for each language.
    """
    counts = (samples.where(F.col("lang").isNotNull())
              .select("lang", F.explode_outer(cells(F.col("text"), n)).alias("cell"))
              .where(F.col("cell").isNotNull())
              .groupBy("lang", "cell").agg(F.count("*").alias("c")))
    total = counts.groupBy("lang").agg(F.sum("c").alias("_t"))
    return counts.join(total, "lang").select("lang", "cell", F.greatest(F.lit(0), F.round(
        F.log(F.col("c") / F.col("_t")) * 1000).cast("int") - floor).alias("w"))


def cells(c: Column, n: int) -> Column:
    """The character n-grams inside the words of a text, each as one of ``CELLS`` numbers."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "), F.lit(" "))
    grams = F.regexp_extract_all(padded, F.lit("(?=(.{" + str(n) + "}))"), F.lit(1))
    return F.transform(grams, lambda g: F.pmod(F.hash(g), F.lit(CELLS)))


def statistical_language(text: Column, profiles: DataFrame, n: int = 3) -> Column:
    """The language whose profile fits the grams of a text best; null if none knows any of them.

    The profiles, at most ``CELLS`` numbers for each of at most ``MOST_LANGUAGES``, become constant
    arrays of the plan; a text is summed up in place, without a join or a shuffle. Weights are
    whole thousandths, so the order of sums cannot change a guess.
    """
    rows = profiles.limit(CELLS * MOST_LANGUAGES + 1).toArrow().to_pydict()
    weights: dict[str, list[int]] = {}
    for lang, cell, w in zip(rows["lang"], rows["cell"], rows["w"]):
        weights.setdefault(lang, [0] * CELLS)[cell] = w
    if len(weights) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to tell apart")
    if not weights:
        return F.lit(None).cast("string")
    tables = {lang: F.split(F.lit(",".join(map(str, w))), ",").cast("array<int>")
              for lang, w in weights.items()}

    def total(found: Column, table: Column) -> Column:
        return F.aggregate(found, F.lit(0).cast("long"), lambda n, cell: n + F.get(table, cell))

    def best(found: Column) -> Column:
        sums = [F.struct(total(found, table).alias("s"), F.lit(lang).alias("lang"))
                for lang, table in sorted(tables.items())]
        return F.array_max(F.filter(F.array(*sums), lambda x: x["s"] > 0))["lang"]

    return F.transform(F.array(cells(text, n)), best)[0]


def tag_language(df: DataFrame, profiles: DataFrame, text: str = "text",
                 active: list[str] | None = None, disabled: list[str] | None = None) -> DataFrame:
    """Statistical guess corrected by rules; adds ``lang_tag``.

    Kana and hangul decide alone; hanzi without kana is Chinese unless the guess is Japanese;
    disabled languages fall back to the simple tag; accents and short texts overrule English,
    Spanish words overrule Portuguese and Chinese.
    """
    act = active if active is not None else lg.ACTIVE
    off = disabled if disabled is not None else lg.DISABLED
    t = tx.strip(F.coalesce(F.col(text), F.lit("")))
    j = (df.withColumn("guess", statistical_language(F.col(text), profiles))
         .withColumn("_words", word_set(t))
         .withColumn("_simple", simple_language(t, F.col("_words"))))
    s, g = F.col("_simple"), F.col("guess")
    accents = t.rlike(f"[{lg.SPANISH_MARKS}]")
    overrule = (s == "es") & (((g == "en") & (accents | (tx.word_count(t) < 4)))
                              | (g == "pt") | g.startswith("zh"))
    tag = (F.when(t == "", "en").when(tx.has_hangul(t), "ko").when(tx.has_kana(t), "ja")
           .when(t.rlike(HANZI_SHORT), F.when(g == "ja", "ja").otherwise("zh"))
           .when((s == "pt") | g.isNull(), s)
           .when(g.isin(off), F.when(s.isin(act), s).otherwise("en"))
           .when(g.isin([*act, "zh-cn", "zh-tw"]),
                 F.when(overrule, s).when(g.startswith("zh"), "zh").otherwise(g))
           .otherwise(s))
    return j.withColumn("lang_tag", tag).drop("_simple", "guess", "_words")


def lexicon_hits(texts: DataFrame, key: list[str], lexicon: DataFrame | None = None,
                 text: str = "text") -> DataFrame:
    """Distinct marker words of each language per text.

    ``lexicon`` is (lang, word), by default the built-in markers. Distinct words of a text are
    exploded and joined, so any lexicon size works; Spark broadcasts it when it is small.
    """
    if lexicon is None:
        spark = texts.sparkSession
        lexicon = spark.createDataFrame(
            [(code, w) for code, ws in lg.MIXED_MARKERS.items() for w in sorted(set(ws))],
            "lang string, word string")
    tokens = texts.select(*key, F.explode(tx.latin_tokens(F.col(text))).alias("word"))
    return (tokens.join(lexicon, "word").groupBy(*key, "lang")
            .agg(F.count("*").alias("hits")))


def page_language(blocks: DataFrame, joined: DataFrame) -> DataFrame:
    """Majority language of a page (page_id, block_id, lang).

    A tie goes to ``joined`` (page_id, page_lang: the language of the joined text) if it is
    among the tied, else to the language of the first block among them.
    """
    votes = blocks.groupBy("page_id", "lang").agg(F.count("*").alias("n"),
                                                  F.min("block_id").alias("first"))
    ranked = votes.join(joined, "page_id", "left")
    order = F.struct("n", (F.col("lang") == F.coalesce("page_lang", F.lit(""))).alias("j"),
                     -F.col("first"))
    return ranked.groupBy("page_id").agg(F.max_by("lang", order).alias("lang"),
                                         F.max("n").alias("votes"))


def script_hints(blocks: DataFrame, min_conf: float = 0.35) -> DataFrame:
    """East Asian languages a page shows, by script counts of confident blocks, best first."""
    t = F.coalesce(F.col("text"), F.lit(""))
    kana, hangul, hanzi = (tx.count_of(t, p) for p in (lg.KANA, lg.HANGUL, lg.HANZI))
    sums = (blocks.where(F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_conf)
            .groupBy("page_id").agg(
                F.sum(F.when(kana > 0, kana + F.least(hanzi, F.lit(2))).otherwise(0)).alias("ja"),
                F.sum(F.when(hangul >= 2, hangul).otherwise(0)).alias("ko"),
                F.sum(F.when((hanzi >= 2) & (kana == 0), hanzi).otherwise(0)).alias("zh")))
    pairs = F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(c).alias("lang"))
                      for c in ("ja", "ko", "zh")])
    hints = F.transform(F.array_sort(F.filter(pairs, lambda p: p["s"] <= -2)),
                        lambda p: p["lang"])
    return sums.withColumn("hints", hints)


def script_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Share of each script, and whether the text is a short East Asian term."""
    t = F.coalesce(F.col(text), F.lit(""))
    classes = {"kana": lg.KANA, "hanzi": lg.HANZI, "hangul": lg.HANGUL,
               "cyrillic": r"[А-Яа-яЁёІіЇїЄєҐґ]", "latin": r"[A-Za-zÀ-ÿ]"}
    out = df
    for name, p in classes.items():
        out = out.withColumn(name + "_share", tx.share(t, p))
    return out.withColumn("cjk_term", is_cjk_term(t))


def is_cjk_term(c: Column) -> Column:
    """At most 16 characters, no blanks, some East Asian script."""
    t = tx.collapse(c)
    return ((t != "") & (F.length(t) <= 16) & ~t.contains(" ")
            & t.rlike(r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"))


def mixed_language_pages(blocks: DataFrame, dominant: str) -> DataFrame:
    """Per page: blocks, blocks with more than one language."""
    tagged = tag_mixed_languages(blocks, dominant)
    return tagged.groupBy("page_id").agg(
        F.count("*").alias("blocks"), F.count_if("mixed").alias("mixed_blocks"),
        F.max("mixed").alias("mixed_page"))
