r"""Text columns: shape, script, language, noise and effect tests, all native expressions.

Everything takes and returns a Column, so a text job stays inside one JVM projection.
``\w`` and ``\b`` are made Unicode-aware with ``(?U)``.
"""

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockflow.rules import effects as fx
from blockflow.rules import languages as lg
from blockflow.rules import patterns as pt

CJK = r"[\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{ac00}-\x{d7a3}\x{4e00}-\x{9fff}]"
# Accented Latin letters (to U+024F and U+1E00-U+1EFF) and the letter each decomposes to.
_PLAIN = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()
          for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
LATIN_FROM = "".join(c for c, plain in _PLAIN.items() if len(plain) == 1)
LATIN_TO = "".join(plain for plain in _PLAIN.values() if len(plain) == 1)


def literals(words) -> Column:
    """A word list as a constant array."""
    return F.array(*[F.lit(w) for w in sorted(set(words))])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row: a generator of one element keeps Spark from
    repeating their expressions in every filter and column that uses them."""
    return df.select("*", F.inline_outer(F.array(F.struct(
        *[c.alias(name) for name, c in columns.items()]))))


def exploded(df: DataFrame, keys: list, items: Column, name: str) -> DataFrame:
    """One row for each item that is not null. The outer form makes the array once; the plain one
    makes it again in a filter on its size."""
    return df.select(*keys, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def strip(c: Column) -> Column:
    """Without blanks at the ends: one match from the first to the last other character, where a
    replacement would look for a blank run at every place."""
    return F.regexp_extract(c, r"(?Us)^\s*+(.*\S|)", 1)


def strip_chars(c: Column, chars: str) -> Column:
    """Remove any of ``chars`` from both ends."""
    cls = "".join("\\" + x if x in r"\[]^-.*()?{}" else x for x in chars)
    return F.regexp_replace(c, f"^[{cls}]+|[{cls}]+$", "")


def collapse(c: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.regexp_replace(strip(c), r"(?U) \s+|[^\S ]\s*", " ")  # single blanks stay untouched


def casefold(c: Column) -> Column:
    """Lower case with the folds that matter for Latin and Greek text."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def plain_latin(c: Column) -> Column:
    """Lower case without accents; anything that is not ASCII afterwards is dropped."""
    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only, strip(F.lower(c))).otherwise(F.regexp_replace(
        strip(F.translate(F.lower(c), LATIN_FROM, LATIN_TO)), r"[^\x{00}-\x{7f}]", ""))


def comparable(c: Column) -> Column:
    """Plain Latin without image references, model tags and repeated blanks."""
    text = F.regexp_replace(plain_latin(c), r"!\[\]\([^)]*\)|<\|[^|]*\|>", "")
    return collapse(text)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def share(c: Column, pattern: str) -> Column:
    """Share of characters that match a one-character pattern."""
    return count_of(c, pattern) / F.greatest(F.length(c), F.lit(1))


def words(c: Column) -> Column:
    """Blank-separated words; an empty text has none."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def latin_tokens(c: Column) -> Column:
    """Distinct case-folded Latin words, apostrophes kept inside."""
    return F.array_distinct(F.regexp_extract_all(
        casefold(c), F.lit(r"([a-zß-öø-ÿA-ZÀ-Þ÷×]+(?:['’][a-zß-öø-ÿA-ZÀ-Þ÷×]+)?)"), F.lit(1)))


def has_kana(c: Column) -> Column:
    return c.rlike(lg.KANA)


def has_hanzi(c: Column) -> Column:
    return c.rlike(lg.HANZI)


def has_hangul(c: Column) -> Column:
    return c.rlike(lg.HANGUL)


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def normal_lang(c: Column, default: str = "auto") -> Column:
    """Language code in its short form."""
    code = F.replace(F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit(default)))),
                     F.lit("_"), F.lit("-"))
    aliases = F.create_map(*[F.lit(x) for kv in lg.ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, code), F.nullif(code, F.lit("")), F.lit(default))


def same_text(a: Column, b: Column) -> Column:
    """Equal once blanks, punctuation and case are ignored."""
    drop = r"(?U)[\s\"'¿¡!?.,;:()\[\]{}_\-]+"
    return casefold(F.regexp_replace(a, drop, "")) == casefold(F.regexp_replace(b, drop, ""))


def looks_like_language(c: Column, lang: Column) -> Column:
    """Script or frequent words of a (normalised) language."""
    tokens = F.transform(words(c), lambda w: strip_chars(casefold(w), ".,;:!?¿¡()[]{}\"'"))
    test = (F.when(lang == "ja", has_kana(c))
            .when(lang == "ko", has_hangul(c) | c.rlike(r"[\x{d7a4}-\x{d7af}]"))
            .when(lang == "zh", has_hanzi(c) & ~has_kana(c)))
    for code, script in lg.SCRIPTS.items():
        test = test.when(lang == code, c.rlike(script))
    for code, common in lg.COMMON_WORDS.items():
        test = test.when(lang == code, F.arrays_overlap(tokens, literals(common)))
    return test.otherwise(F.lit(False))


# --- sound effects ---------------------------------------------------------------------------

def is_effect_quality(c: Column, kind: Column) -> Column:
    """Effect by declared type, known word, a letter three times in a row, or stars."""
    typed = F.replace(F.lower(strip(F.coalesce(kind, F.lit("")))), F.lit("-"), F.lit("_")).isin(
        fx.EFFECT_TYPES)
    bare = F.lower(strip_chars(c, " '!?.,;:~-_()[]{}"))
    return typed | ((bare != "") & (F.length(bare) <= 20) & (
        bare.isin(fx.KNOWN_EFFECTS) | bare.rlike(r"(.)\1{2,}")
        | (bare.startswith("*") & bare.endswith("*"))))


def is_effect_translator(c: Column) -> Column:
    """Effect by spelling: repeated words or glyphs, short capitals, known romanised sounds."""
    t = strip(c)
    tokens = F.regexp_extract_all(F.lower(t), F.lit(r"(?U)(\w+)"), F.lit(1))
    spoken = fx.NOT_EFFECTS + [w for ws in lg.MIXED_MARKERS.values() for w in ws]
    collapsed = F.transform(tokens, lambda w: F.regexp_replace(w, r"(.)\1+", "$1"))
    glyphs = F.regexp_replace(t, CJK.replace("[", "[^", 1), "")
    shaped = glyphs.rlike(r"^(.)\1+$") | any_of(t.rlike(p) for p in fx.EFFECT_PATTERNS)
    return ((t != "") & (F.length(t) <= 25) & shaped
            & ~F.arrays_overlap(tokens, literals(spoken))
            & ~F.arrays_overlap(collapsed, literals(fx.INTERJECTIONS)))


def is_effect_repair(c: Column) -> Column:
    """Effect among retry candidates: a letters-only word of 3 to 8, known or with a triple."""
    s = F.upper(strip_chars(c, " '\"¡¿!?.,;:~-_()"))
    return (s.rlike(r"^\p{L}{3,8}$") & ~s.isin(fx.REPAIR_NOT_EFFECTS)
            & (s.isin(fx.REPAIR_EFFECTS) | s.rlike(r"(.)\1{2,}")))


# --- noise -----------------------------------------------------------------------------------

def is_noise_quality(c: Column) -> Column:
    """Strong signs of a bad reading, as the quality audit sees them."""
    t = strip(c)
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    return ((t != "") & ~has_kana(t) & ~has_hanzi(t) & ~t.rlike(r"[\x{ac00}-\x{d7af}]") & (
        t.rlike(r"(?U)^[\d\s.,;:'\"\-_~]+$")
        | t.rlike(r"(?U)\d[A-Z]{5,}|[A-Z]{6,}\d|\d{2,}[A-Z]{2,}\d{2,}".replace("(?U)", ""))
        | (share(t, r"\p{Nd}") > 0.4)
        | (count_of(t, r"[@#$%^&*+=<>\[\]{}|\\/]") >= 3)
        | ((F.length(letters) <= 2) & ~letters.rlike("[aeiouAEIOU]")
           & ~letters.rlike(r"[^\x{00}-\x{7f}]"))))


def is_noise_translator(c: Column) -> Column:
    """Signs of a bad reading that make a paid translation pointless."""
    t = strip(c)
    n = F.length(t)
    lowered = F.lower(t)
    letters = F.regexp_replace(F.upper(t), r"[^\p{L}]", "")
    digits = share(t, r"\p{Nd}")
    return ((n >= 2) & ~t.rlike(r"(?i)^\d+(?:st|nd|rd|th)$") & (
        (digits > 0.30)
        | (t.rlike(r"\d{2,}") & (~t.rlike(r"\p{L}") | (share(t, r"\p{L}") < 0.4)))
        | t.rlike(r"[@#$%^&*+=<>{}|\\/]{2,}")
        | (F.upper(t).rlike(r"(.)\1{4,}") & letters.rlike(r"^([AEIOUH])\1*$|^$") & (n >= 5))
        | (count_of(t, r"[^\x{00}-\x{7f}áéíóúñüÁÉÍÓÚÑÜ¿¡]") >= 2)
        | ((n <= 3) & ~lowered.rlike("[aeiouáéíóúü]") & ~t.rlike(r"\p{Nd}")
           & ~lowered.isin(fx.SHORT_WORDS))))


def case_flips(c: Column) -> Column:
    """Places where two neighbouring letters differ in case (matches may overlap)."""
    return F.regexp_count(c, F.lit(r"\p{Lu}(?=\p{L}(?<!\p{Lu}))|\p{L}(?<!\p{Lu})(?=\p{Lu})"))


def is_noise_manager(c: Column) -> Column:
    """Few letters, or letters that keep changing case."""
    t = strip(c)
    letters = count_of(t, r"\p{L}")
    return (F.length(t) >= 3) & (
        (letters / F.length(t) < 0.35)
        | ((letters >= 4) & t.rlike(r"\p{Lu}") & t.rlike(r"\p{Ll}")
           & (case_flips(t) > F.length(t) * 0.35)))


# --- translations ----------------------------------------------------------------------------

def occurrences(text: Column, piece: Column) -> Column:
    """Non-overlapping occurrences of a non-empty piece."""
    gone = F.length(text) - F.length(F.replace(text, piece, F.lit("")))
    return F.floor(gone / F.greatest(F.length(piece), F.lit(1)))


def distinct_char_share(c: Column) -> Column:
    return (F.size(F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != "")))
            / F.greatest(F.length(c), F.lit(1)))


def is_valid_translation(source: Column, target: Column) -> Column:
    """A target that is not blank, a copy, glued repeats, too uniform, or far too long."""
    src = F.coalesce(source, F.lit(""))
    tgt = F.coalesce(target, F.lit(""))
    n = F.length(tgt)
    prefix = any_of(
        (n > 20) & (n >= w * 3) & (occurrences(tgt, F.substring(tgt, 1, w))
                                   > F.floor(n / w) * 0.7) for w in (10, 15, 20))
    return ((strip(tgt) != "")
            & ~((strip(src) != "") & (casefold(collapse(src)) == casefold(collapse(tgt))))
            & ~tgt.rlike(r"(.{4,20})\1+")
            & ~((n > 20) & (distinct_char_share(tgt) < 0.15))
            & ~prefix
            & ~((src != "") & (n > F.length(src) * 8)))


def is_valid_translation_offline(source: Column, target: Column) -> Column:
    """The older rule set: ten times as long, and a prefix that comes five times."""
    src = F.coalesce(source, F.lit(""))
    tgt = F.coalesce(target, F.lit(""))
    n = F.length(tgt)
    sizes = F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(30), F.floor(n / 5)
                                                              .cast("int")) - 1))
    repeated = (n > 10) & (F.floor(n / 5) > 2) & F.exists(
        sizes, lambda k: (k * 5 <= n) & (occurrences(tgt, F.substr(tgt, F.lit(1), k)) >= 5))
    return ((strip(tgt) != "") & (strip(tgt) != strip(src))
            & ~((n > 20) & (distinct_char_share(tgt) < 0.15))
            & ~((src != "") & (n > F.length(src) * 10)) & ~repeated)


def is_source_leftover(text: Column, source: Column, target: Column) -> Column:
    """The output is clearly still in the source language."""
    src, tgt = normal_lang(source, ""), normal_lang(target, "")
    script = (F.when(src == "ko", count_of(text, lg.HANGUL))
              .when(src == "zh", count_of(text, lg.HANZI))
              .when(src == "ja", count_of(text, lg.KANA)))
    letters = F.greatest(count_of(text, r"\p{L}"), F.lit(1))
    tokens = latin_tokens(text)

    def score(lang: Column) -> Column:
        hit = None
        for code, marks in lg.MIXED_MARKERS.items():
            n = F.size(F.array_intersect(tokens, literals(marks)))
            hit = F.when(lang == code, n) if hit is None else hit.when(lang == code, n)
        return hit.otherwise(0)

    return ((text != "") & (src != "") & (src != tgt)
            & F.when(script.isNotNull(),
                     (script > 0) & ((script >= 3) | (script / letters >= 0.5)))
            .otherwise((score(src) >= 2) & (score(src) >= score(tgt) + 1)))


def apply_rules(c: Column, rules) -> Column:
    """Ordered substitutions, case ignored.

    Most texts match no rule: one test for all of them spares these the whole chain. Nearly all
    rules begin at the border of a word, which the test looks for once and not rule by rule.
    """
    if not rules:
        return c
    changed = reduce(lambda t, r: F.regexp_replace(t, "(?iuU)" + r[0], r[1]), rules, c)
    at_border = [f"(?:{r[0][2:]})" for r in rules if r[0].startswith(r"\b")]
    others = [f"(?:{r[0]})" for r in rules if not r[0].startswith(r"\b")]
    tests = others + ([rf"\b(?:{'|'.join(at_border)})"] if at_border else [])
    return F.when(c.rlike("(?iuU)" + "|".join(tests)), changed).otherwise(c)


def strip_symbols(c: Column) -> Column:
    return strip(F.regexp_replace(c, pt.SYMBOLS, ""))
