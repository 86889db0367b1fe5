"""Line-first cleaning: rules per line, failing lines go, documents that lose too much go too.

A line with a word fails when it is
* boilerplate: it holds one of the fixed phrases;
* navigation: it has three or more menu separators, or at most six words that are all menu words;
* shouting or symbols: capitals A-Z twice as many as small letters (ten at least), or more than one
  symbol for every ten characters of words;
* a fragment: under eight words and no closing punctuation.
A document is rejected when the failing lines hold more than half of its word characters. Lines
without a word are dropped and count as nothing.

Everything is one projection of native functions over the row: no shuffle, no Python.

Defined results: a null or empty text has no words, fails the base rules and is rejected, its clean
text is empty; repeated rows are judged each for themselves; columns that are not asked for are not
read; an empty table gives an empty result. Very long texts take n log n in their words.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.llm.common import BLANKS, let, table, words_of

# Phrases of boilerplate, words of menus, separators of menus.
BOILERPLATE = ["all rights reserved", "accept cookies", "cookie policy", "use of cookies",
               "privacy policy", "terms of use", "terms of service", "enable javascript",
               "lorem ipsum", "click here", "subscribe to our", "sign up for our", "powered by",
               "skip to content", "page not found", "share this"]
MENU_WORDS = ["home", "menu", "login", "logout", "search", "next", "previous", "back", "contact",
              "about", "register", "sitemap", "help", "faq", "sign", "in", "up", "us"]
SEPARATORS = "|>»·•"
SYMBOLS = "#*$%&|<>"
SHORT_LINE = 8      # words of a line that may not lack closing punctuation
LOST_SHARE = 50     # per cent of the word characters that failing lines may hold
MIN_WORDS = 10
REPEAT_SHARE = 20   # per cent of the words that may lie in repeated windows
WINDOW = 5

_BOILERPLATE = "(?i)" + "|".join(BOILERPLATE)
_MENU = "(?i)^[^A-Za-z]*(" + "|".join(MENU_WORDS) + ")([^A-Za-z]+(" + "|".join(MENU_WORDS) + \
    ")){0,5}[^A-Za-z]*$"
_CLOSED = "[.!?:;…。！？][\"'”’»)\\]]*[ \\t\\r]*$"


def word_chars(text: Column) -> Column:
    """Code points of a text that are no blanks."""
    return F.length(F.translate(text, BLANKS, ""))


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    capitals = _without(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    small = _without(line, "abcdefghijklmnopqrstuvwxyz")
    return (line.rlike(_BOILERPLATE) | (_without(line, SEPARATORS) >= 3) | line.rlike(_MENU)
            | ((capitals >= 10) & (capitals > 2 * small))
            | (_without(line, SYMBOLS) * 10 > word_chars(line))
            | ((F.size(words_of(line)) < SHORT_LINE) & ~line.rlike(_CLOSED)))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window found twice or more.

    Windows are compared by a 64-bit hash. Where some hash repeats, (hash, place) pairs are
    sorted, equal neighbours give the places, and each place adds the words that the place before
    does not cover.
    """
    def covered(hashes: Column) -> Column:
        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"),
                                                                          i.alias("i")))),
                   lambda s: let(F.sort_array(F.transform(
                       F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"],
                                                           F.lit(False))
                                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
                       lambda x: x["i"])),
                       lambda p: F.aggregate(
                           F.transform(p, lambda x, i: F.least(
                               F.lit(WINDOW), x - F.coalesce(F.get(p, i - 1), F.lit(-WINDOW)))),
                           F.lit(0), lambda a, x: a + x)))

    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
               .otherwise(covered(h)))


def judged(text: Column) -> Column:
    """All figures of a text as one struct."""
    def of_lines(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: word_chars(x) > 0)
        return let(lines, lambda x: let(F.filter(x, lambda y: ~line_fails(y)), lambda good: F.struct(
            F.size(x).alias("n_lines"), (F.size(x) - F.size(good)).alias("n_bad_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            (word_chars(t) - word_chars(F.array_join(good, "\n"))).alias("lost_chars"),
            F.array_join(good, "\n").alias("clean_text"))))

    t = F.coalesce(text, F.lit(""))
    return F.struct(
        let(words_of(t), lambda w: F.struct(F.size(w).alias("n_words"),
                                            repeated_words(w).alias("n_repeat_words"))).alias("w"),
        of_lines(t).alias("l"), word_chars(t).alias("word_chars"),
        _without(t, SYMBOLS).alias("n_symbols"))


def clean(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document with its figures, verdicts and clean text."""
    rows = docs.select(*keep, let(F.array(F.col("text").cast("string")),
                                  lambda t: judged(t[0])).alias("_j"))
    j = F.col("_j")
    figures = {"n_words": j["w"]["n_words"], "word_chars": j["word_chars"],
               "n_symbols": j["n_symbols"], "n_dup_lines": j["l"]["n_dup_lines"],
               "n_repeat_words": j["w"]["n_repeat_words"], "n_lines": j["l"]["n_lines"],
               "n_bad_lines": j["l"]["n_bad_lines"], "lost_chars": j["l"]["lost_chars"]}
    base_failed = ((j["w"]["n_words"] < MIN_WORDS)
                   | (100 * j["w"]["n_repeat_words"] > REPEAT_SHARE * j["w"]["n_words"]))
    lost = 100 * j["l"]["lost_chars"] > LOST_SHARE * j["word_chars"]
    return rows.select(*keep, *(v.cast("long").alias(k) for k, v in figures.items()),
                       base_failed.alias("base_failed"), (~base_failed & ~lost).alias("kept"),
                       j["l"]["clean_text"].alias("clean_text"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    return clean(table(spark, sf_dir, "documents"), ["doc_id"]).drop("clean_text")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents that pass, without their failing lines."""
    rows = clean(docs.select(F.struct(*docs.columns).alias("_row"), "text"), ["_row"])
    text = F.when(F.col("n_bad_lines") > 0, F.col("clean_text")).otherwise(F.col("_row.text"))
    return rows.filter("kept").select(*(
        text.alias(c) if c == "text" else
        F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
        F.col("_row")[c].alias(c) for c in docs.columns))


def _duck(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def _duck_without(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, {_duck(characters)}, '')))"


_D_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_D_FAILS = f"""(regexp_matches(x, {_duck(_BOILERPLATE)}) or {_duck_without('x', SEPARATORS)} >= 3
  or regexp_matches(x, {_duck(_MENU)})
  or ({_duck_without('x', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')} >= 10
      and {_duck_without('x', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')}
          > 2 * {_duck_without('x', 'abcdefghijklmnopqrstuvwxyz')})
  or {_duck_without('x', SYMBOLS)} * 10 > length(translate(x, {_D_BLANKS}, ''))
  or (len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) < {SHORT_LINE}
      and not regexp_matches(x, {_duck(_CLOSED)})))"""

ORACLE = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
f as (select r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
        length(translate(t, {_D_BLANKS}, '')) as word_chars,
        {_duck_without('t', SYMBOLS)} as n_symbols,
        list_filter(string_split(t, chr(10)),
                    lambda x: length(translate(x, {_D_BLANKS}, '')) > 0) as l from d),
g as (select r, unnest(range(0, len(w) - {WINDOW - 1})) as i,
        unnest(list_transform(range(0, len(w) - {WINDOW - 1}),
          lambda k: array_to_string(w[k + 1:k + {WINDOW}], ' '))) as x from f
      where len(w) >= {WINDOW}),
h as (select r, i from (select r, i, count(*) over (partition by r, x) as n from g) where n > 1),
p as (select r, sum(least({WINDOW}, step)) as n_repeat_words from (
        select r, i - coalesce(lag(i) over (partition by r order by i), -{WINDOW}) as step from h)
      group by r),
s as (select f.*, coalesce(n_repeat_words, 0) as n_repeat_words,
        list_filter(l, lambda x: not {_D_FAILS}) as good from f left join p using (r)),
z as (select *, word_chars - length(translate(array_to_string(good, chr(10)), {_D_BLANKS}, ''))
               as lost_chars,
        len(w) < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_SHARE} * len(w) as base_failed
      from s)
select doc_id, len(w)::bigint as n_words, word_chars::bigint as word_chars,
  n_symbols::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, len(l)::bigint as n_lines,
  (len(l) - len(good))::bigint as n_bad_lines, lost_chars::bigint as lost_chars, base_failed,
  not base_failed and not 100 * lost_chars > {LOST_SHARE} * word_chars as kept
from z"""

QUERIES = {"op6_line_rules": op6_line_rules}
ORACLES = {"op6_line_rules": ORACLE}
