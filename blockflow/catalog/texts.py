"""Text jobs over ``documents``, ``blocks``, ``pairs`` and ``memory_events``."""

from pyspark.sql import functions as F

from blockflow.catalog import duck
from blockflow.catalog.boxes import NOISE
from blockflow.catalog.duck import sql_in, sql_list
from blockflow.fixtures import cte
from blockflow.functions import text as tx
from blockflow.operators import language as la
from blockflow.operators import texts as t
from blockflow.rules import effects as ef
from blockflow.rules import glossary as gl
from blockflow.rules import languages as lg
from blockflow.rules import patterns as pt

MARKS = "[" + lg.SPANISH_MARKS + "]"
ENDINGS = "(" + "|".join(lg.SPANISH_VERB_ENDINGS) + ")$"


def simple_sql(text: str, tokens: str) -> str:
    """Simple language tag; ``tokens`` is the list of stripped lower-case words."""
    return f"""case when regexp_matches({text}, '[\\x{{ac00}}-\\x{{d7a3}}]') then 'ko' when regexp_matches({text}, '[\\x{{3040}}-\\x{{30ff}}]') then 'ja'
      when regexp_matches({text}, '[\\x{{4e00}}-\\x{{9faf}}]') then 'zh' when regexp_matches({text}, '{MARKS}') then 'es'
      when list_has_any({tokens}, {sql_list(sorted(set(lg.SPANISH_WORDS)))}) then 'es'
      when len(list_filter({tokens}, lambda w: (regexp_matches(w, '{ENDINGS}') and length(w) > 2) or (ends_with(w, 'mente') and length(w) > 6))) > 0 then 'es'
      when list_has_any({tokens}, ['ar','er','ir']) then 'en'
      when len(list_intersect({tokens}, {sql_list(lg.PORTUGUESE_WORDS)})) >= 2 then 'pt'
      when list_has_any({tokens}, {sql_list(lg.PORTUGUESE_DISTINCTIVE)}) then 'pt' else 'en' end"""


def tokens_sql(text: str) -> str:
    return (f"list_distinct(list_transform(list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w <> ''), "
            "lambda w: regexp_replace(w, '^[.,¡!¿?()\\[\\]{}*\"'']+|[.,¡!¿?()\\[\\]{}*\"'']+$', '', 'g')))")


LATIN = f"list_distinct(regexp_extract_all({duck.fold('text')}, '[a-zß-öø-ÿA-ZÀ-Þ÷×]+(?:[''’][a-zß-öø-ÿA-ZÀ-Þ÷×]+)?'))"


def hits_sql(words) -> str:
    return f"len(list_intersect(tok, {sql_list(sorted(set(words)))}))"


MIXED_TESTS = [
    ("ko", "regexp_matches(text, '[\\x{ac00}-\\x{d7a3}]')"),
    ("ja", "regexp_matches(text, '[\\x{3040}-\\x{30ff}]')"),
    ("zh", "regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') and not regexp_matches(text, '[\\x{3040}-\\x{30ff}]')"),
    *[(c, f"{hits_sql(w)} >= 2") for c, w in lg.MIXED_MARKERS.items()],
    ("en", f"dom <> 'en' and own >= 2 and {hits_sql(lg.SINGLE_ENGLISH_MARKERS)} > 0"),
    *[(c, f"dom <> '{c}' and own >= 2 and {hits_sql(w)} > 0")
      for c, w in lg.SINGLE_DISTINCTIVE_MARKERS.items()],
    *[(c, f"dom = '{c}'") for c in lg.ACTIVE],
]


def mixed_sql(source: str, dominant: str) -> str:
    """CTE chain over ``source`` with ``text``: adds ``languages`` as a list."""
    own = " ".join(f"when '{c}' then {hits_sql(w)}" for c, w in lg.MIXED_MARKERS.items())
    found = ", ".join(f"case when {test} then '{c}' end" for c, test in MIXED_TESTS)
    return f"""m0 as (select *, {LATIN} as tok, case when {dominant} in {sql_in(lg.DISABLED)} then 'en' else {dominant} end as dom from {source}),
m1 as (select *, case dom {own} else 0 end as own from m0),
m2 as (select *, list_distinct(list_filter([{found}], lambda x: x is not null)) as found from m1),
mixed as (select *, case when {duck.strip('text')} = '' then [] when len(found) <= 1 then [dom]
   else list_concat(case when list_contains(found, dom) then [dom] else [] end, list_sort(list_filter(found, lambda x: x <> dom))) end as languages from m2)"""


def plain_rules(fx, rules):
    """Glossary over accent-free text, where every engine agrees on word borders."""
    plain = fx.blocks.where("engine = 0").select("page_id", "i", F.concat(
        F.regexp_replace(F.translate("text", tx.LATIN_FROM, tx.LATIN_TO), r"[^\x{00}-\x{7f}]", ""),
        F.when(F.col("i") % 4 == 1, " tuis 0 TEMPORADA7 R @ 5in").when(
            F.col("i") % 4 == 2, " PAGE 1ero TEMPORARY 3 SCAN segundo").otherwise("")).alias("text"))
    return t.apply_glossary(plain, rules)


PLAIN_RULES = cte("blocks") + r""", p as (select page_id, i, regexp_replace(strip_accents(text), '[^\x00-\x7f]', '', 'g')
   || case when i % 4 = 1 then ' tuis 0 TEMPORADA7 R @ 5in' when i % 4 = 2 then ' PAGE 1ero TEMPORARY 3 SCAN segundo' else '' end as text from blocks where engine = 0)
"""


def rules_sql(rules) -> str:
    out = "text"
    for pattern, replacement in rules:
        if any(ord(ch) > 127 for ch in pattern):
            continue  # cannot match ASCII text
        out = (f"regexp_replace({out}, '{pattern}', "
               f"'{replacement.replace('$1', chr(92) + '1')}', 'gi')")
    return out


TRANSLATOR_FX = r"""(s <> '' and length(s) <= 25
   and not list_has_any(regexp_extract_all(lower(s), '[\p{L}\p{M}\p{N}_]+'), §EX)
   and (regexp_matches(s, '(?i)^[A-Z]{3,}\s+\d+$') or regexp_matches(s, '^[A-Z]{3,8}$') or regexp_matches(s, '(?i)^[A-Z]{3,}[!?.…:]+$')
     or regexp_matches(s, '(?i)^(§RO)\d*[!?.]*$') or regexp_matches(s, '^\*[^*]+\*$')))"""
FX_SQL = TRANSLATOR_FX.replace("§EX", sql_list(sorted(set(
    ef.NOT_EFFECTS + [w for ws in lg.MIXED_MARKERS.values() for w in ws])))).replace(
    "§RO", "|".join(ef.ROMANISED))


def first_words(fx):
    """First word of every block in capitals, with marks: what effects look like."""
    w = F.upper(F.regexp_replace(F.translate(F.split(F.trim("text"), " ")[0], tx.LATIN_FROM,
                                             tx.LATIN_TO), r"[^A-Za-z]", ""))
    return fx.blocks.where("engine = 0").select("page_id", "i", F.when(
        F.col("i") % 3 == 1, F.concat(F.lit("*"), w, F.lit("*"))).when(
        F.col("i") % 3 == 2, F.concat(w, F.lit("!"))).otherwise(w).alias("text"))


FIRST = cte("blocks") + r""", fw as (select page_id, i, upper(regexp_replace(strip_accents(string_split(trim(text), ' ')[1]), '[^A-Za-z]', '', 'g')) as w from blocks where engine = 0),
ft as (select page_id, i, case i % 3 when 1 then '*' || w || '*' when 2 then w || '!' else w end as s from fw)
"""
LONE = (r"(length(regexp_replace(lower(s), '[^a-z]', '', 'g')) > 0 and regexp_replace(lower(s), '[^a-z]', '', 'g') in ("
        + ",".join(f"'{w}'" for w in ef.INTERJECTIONS) + "))")


def honorific_input(fx):
    return fx.memory_events.select("event_id", F.col("source").alias("src"), F.col(
        "translation").alias("result"), F.when(F.col("event_id") % 2 == 0, "ja").otherwise("ko")
        .alias("source_lang"))


def requests(fx):
    return fx.documents.select(
        "doc_id", F.col("source").alias("batch_id"), "text",
        F.when(F.col("doc_id") % 11 == 0, "xx").when(F.col("doc_id") % 11 == 1, "en").otherwise(
            F.when(F.col("lang") == "fr", "auto").otherwise(F.col("lang"))).alias("source_lang"),
        F.when(F.col("doc_id") % 11 == 3, "auto").otherwise("en").alias("target_lang"))


def tagged_blocks(fx):
    return la.tag_language_simple(fx.blocks.where("engine = 0"), out="lang")


BLOCK_LANG = (cte("blocks") + f", b0 as (select *, {tokens_sql('text')} as stok from blocks where engine = 0), "
              f"tb as (select page_id, block_id, i, text, {simple_sql('text', 'stok')} as lang from b0)\n")

QUERIES = {
    "tag_language_simple": lambda fx: la.tag_language_simple(fx.documents).select(
        "doc_id", "lang_tag"),
    "tag_mixed_languages": lambda fx: la.tag_mixed_languages(fx.documents, "lang").select(
        "doc_id", F.array_join("languages", ",").alias("languages"), "mixed"),
    "tag_language": lambda fx: la.tag_language(fx.documents, la.language_profiles(fx.documents))
    .select("doc_id", "lang_tag"),
    "lexicon_hits": lambda fx: la.lexicon_hits(fx.documents, ["doc_id"]),
    "page_language": lambda fx: la.page_language(
        tagged_blocks(fx), fx.documents.select(F.col("doc_id").alias("page_id"), F.col("lang")
                                               .alias("page_lang"))),
    "script_hints": lambda fx: la.script_hints(fx.memory_events.select(
        (F.col("event_id") % 997).alias("page_id"), F.col("source").alias("text"),
        F.col("quality").alias("confidence"))).withColumn("hints", F.array_join("hints", ",")),
    "script_profile": lambda fx: la.script_profile(fx.memory_events.select(
        "event_id", F.concat("source", F.when(F.col("event_id") % 3 == 0, " abc").otherwise(""))
        .alias("text"))).select("event_id", "kana_share", "hanzi_share", "latin_share",
                                "cjk_term"),
    "mixed_language_pages": lambda fx: la.mixed_language_pages(tagged_blocks(fx), "lang"),
    "apply_glossary": lambda fx: plain_rules(fx, gl.BEFORE),
    "apply_glossary_after": lambda fx: plain_rules(fx, gl.AFTER),
    "strip_symbols": lambda fx: t.strip_symbols(fx.documents.select("doc_id", "text")),
    "caps_roundtrip": lambda fx: t.caps_restore(t.caps_query(fx.blocks.where("engine = 0").select(
        "page_id", "i", F.when(F.col("i") % 2 == 0, F.upper("text")).otherwise(F.col("text"))
        .alias("text"))).withColumn("result", F.lower("query"))).select(
        "page_id", "i", "all_caps", "result"),
    "post_process_translation": lambda fx: t.post_process_translation(fx.blocks.where(
        "engine = 0").select("page_id", "i", F.concat(F.lower("text"), F.lit("  x y"))
                             .alias("result"))),
    "keep_honorifics": lambda fx: t.keep_honorifics(honorific_input(fx)).select(
        "event_id", "result"),
    "keep_name_or_effect": lambda fx: t.keep_name_or_effect(first_words(fx).select(
        "page_id", "i", F.col("text").alias("src"), F.initcap(F.lower("text")).alias("tgt"),
        F.when(F.col("i") % 7 == 0, "sfx").alias("block_type"))).select("page_id", "i", "kept"),
    "tag_effects": lambda fx: t.tag_effects(first_words(fx)).where("effect").groupBy(
        "text").agg(F.count("*").alias("n")),
    "tag_effects_quality": lambda fx: t.tag_effects(first_words(fx), "quality").select(
        "page_id", "i", "effect"),
    "tag_effects_repair": lambda fx: t.tag_effects(first_words(fx), "repair").select(
        "page_id", "i", "effect"),
    "tag_ocr_noise": lambda fx: t.tag_ocr_noise(fx.blocks, "translator").select(
        "page_id", "block_id", "noise"),
    "tag_ocr_noise_quality": lambda fx: t.tag_ocr_noise(fx.blocks, "quality").select(
        "page_id", "block_id", "noise"),
    "tag_ocr_noise_manager": lambda fx: t.tag_ocr_noise(fx.blocks, "manager").select(
        "page_id", "block_id", "noise"),
    "tag_valid_translation": lambda fx: t.tag_valid_translation(fx.pairs).select(
        "doc_id", "seq", "valid"),
    "tag_valid_translation_offline": lambda fx: t.tag_valid_translation(
        fx.pairs, "offline").select("doc_id", "seq", "valid"),
    "tag_target_language": lambda fx: t.tag_target_language(fx.documents, "text", "lang").select(
        "doc_id", "looks_right"),
    "tag_source_leftover": lambda fx: t.tag_source_leftover(fx.documents.select(
        "doc_id", F.col("text").alias("tgt"), F.lit("en").alias("source_lang"),
        F.lit("es").alias("target_lang"))).select("doc_id", "leftover"),
    "normalize_text": lambda fx: t.normalize_text(fx.documents, "markup").select(
        "doc_id", F.length("normal").alias("n"), F.md5("normal").alias("digest")),
    "validate_requests": lambda fx: t.validate_requests(requests(fx)).select("doc_id", "error"),
    "coerce_flags": lambda fx: t.coerce_flags(fx.events.select(
        "event_id", F.when(F.col("event_id") % 5 == 0, " YES ").when(
            F.col("event_id") % 5 == 1, "0").when(F.col("event_id") % 5 == 2, "maybe").otherwise(
            F.col("event_type")).alias("a"), (F.col("event_id") % 3).cast("string").alias("b")),
        {"a": False, "b": True}),
    "document_keys": lambda fx: t.document_keys(fx.pages.select(
        "page_id", F.col("url").alias("name"), F.col("url").alias("scope"),
        F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("0.1:"), F.col("page_id")))
        .alias("signature"))).select("page_id", "doc_key", "doc_key_sha", "doc_md5", "doc_sha256", "clean_scope",
                                     "scoped_signature"),
    "natural_sort_key": lambda fx: t.natural_sort_key(fx.pages.select(
        "page_id", F.col("url").alias("name"))).select("page_id", "sort_key"),
    "page_range": lambda fx: t.page_range(fx.lineitem.select(
        "l_orderkey", F.col("l_linenumber").alias("page")), "2-4").groupBy("page").agg(
        F.count("*").alias("n")),
}

GLYPH_NAME = r"^[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}々]+\s*(先輩|先生|様)$"
ORACLES = {
    "tag_language_simple": f"with d as (select doc_id, text, {tokens_sql('text')} as tok from documents) select doc_id, {simple_sql('text', 'tok')} as lang_tag from d",
    "tag_mixed_languages": f"with {mixed_sql('documents', 'lang')} select doc_id, array_to_string(languages, ',') as languages, len(languages) > 1 as mixed from mixed",
    "lexicon_hits": f"""with d as (select doc_id, {LATIN} as tok from documents), l as (select * from (values {', '.join(f"('{c}', {sql_list(sorted(set(w)))})" for c, w in lg.MIXED_MARKERS.items())}) v(lang, words))
      select doc_id, lang, len(list_intersect(tok, words)) as hits from d cross join l where len(list_intersect(tok, words)) > 0""",
    "page_language": BLOCK_LANG + """, v as (select page_id, lang, count(*) as n, min(block_id) as f from tb group by 1, 2)
      select page_id, v.lang, n as votes from v join documents d on d.doc_id = v.page_id
      qualify row_number() over (partition by page_id order by n desc, v.lang = d.lang desc, f) = 1""",
    "script_hints": cte("memory_events") + r""", t as (select event_id % 997 as page_id, len(regexp_extract_all(source, '[\x{4e00}-\x{9fff}]')) as h from memory_events where quality >= 0.35),
      s as (select page_id, 0::bigint as ja, 0::bigint as ko, sum(case when h >= 2 then h else 0 end)::bigint as zh from t group by 1)
      select *, case when zh >= 2 then 'zh' else '' end as hints from s""",
    "script_profile": cte("memory_events") + r""", t as (select event_id, source || case when event_id % 3 = 0 then ' abc' else '' end as t from memory_events)
      select event_id, len(regexp_extract_all(t, '[\x{3040}-\x{30ff}]')) / length(t) as kana_share, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) / length(t) as hanzi_share,
        len(regexp_extract_all(t, '[A-Za-zÀ-ÿ]')) / length(t) as latin_share, length(t) <= 16 and not contains(t, ' ') and regexp_matches(t, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') as cjk_term from t""",
    "mixed_language_pages": BLOCK_LANG + f", {mixed_sql('tb', 'lang')} select page_id, count(*) as blocks, count(*) filter (len(languages) > 1) as mixed_blocks, bool_or(len(languages) > 1) as mixed_page from mixed group by 1",
    "apply_glossary": PLAIN_RULES + f"select page_id, i, {rules_sql(gl.BEFORE)} as text from p",
    "apply_glossary_after": PLAIN_RULES + f"select page_id, i, {rules_sql(gl.AFTER)} as text from p",
    "strip_symbols": f"""with d as (select doc_id, {duck.strip('text')} as s from documents) select doc_id, case when {FX_SQL} and not {LONE} then s else {duck.strip("regexp_replace(s, '" + pt.SYMBOLS + "', '', 'g')")} end as text from d""",
    "caps_roundtrip": cte("blocks") + r""", u as (select page_id, i, case when i % 2 = 0 then replace(upper(text), 'ẞ', 'SS') else text end as t from blocks where engine = 0),
      v as (select *, regexp_matches(t, '\p{Lu}') and not regexp_matches(t, '\p{Ll}') and length(t) > 1 as c from u) select page_id, i, c as all_caps, case when c then replace(upper(lower(t)), 'ẞ', 'SS') else lower(t) end as result from v""",
    "post_process_translation": cte("blocks") + rf""", u as (select page_id, i, regexp_replace({duck.strip("lower(text) || '  x y'")}, '\s{{2,}}', ' ', 'g') as s from blocks where engine = 0)
      select page_id, i, case when regexp_matches(s, '^\p{{Ll}}') and not {FX_SQL} then replace(upper(substr(s, 1, 1)), 'ẞ', 'SS') || substr(s, 2) else s end as result from u""",
    "keep_honorifics": cte("memory_events") + f""", t as (select *, regexp_extract(source, '{GLYPH_NAME}', 1) as suffix from memory_events)
      select event_id, case when event_id % 2 = 0 and suffix <> '' then translation || case suffix when '先生' then '-sensei' when '様' then '-sama' else '-senpai' end else translation end as result from t""",
    "keep_name_or_effect": FIRST + r""", k as (select *, upper(substr(lower(s),1,1)) || substr(lower(s),2) as t from ft)
      select page_id, i, i % 7 = 0 or (s <> '' and regexp_matches(s, '[A-Z]') and regexp_matches(t, '^[A-Z][a-z]{2,}$')) as kept from k""",
    "tag_effects_quality": FIRST + f""", b as (select *, lower(trim(s, ' ''!?.,;:~-_()[]{{}}')) as bare from ft)
      select page_id, i, bare <> '' and length(bare) <= 20 and (bare in {sql_in(ef.KNOWN_EFFECTS)} or {duck.triple('bare')} or (starts_with(bare,'*') and ends_with(bare,'*'))) as effect from b""",
    "tag_effects_repair": FIRST + f""", b as (select *, upper(trim(s, ' ''"¡¿!?.,;:~-_()')) as z from ft)
      select page_id, i, regexp_matches(z, '^\\p{{L}}{{3,8}}$') and z not in {sql_in(ef.REPAIR_NOT_EFFECTS)} and (z in {sql_in(ef.REPAIR_EFFECTS)} or {duck.triple('z')}) as effect from b""",
    "tag_ocr_noise": cte("blocks") + f", b as (select page_id, block_id, {duck.strip('text')} as t from blocks) select page_id, block_id, {NOISE} as noise from b",
    "tag_ocr_noise_quality": cte("blocks") + f", b as (select page_id, block_id, {duck.strip('text')} as t from blocks) select page_id, block_id, {duck.garbage('t')} as noise from b",
    "tag_ocr_noise_manager": cte("blocks") + r""", b as (select page_id, block_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as s from blocks),
      c as (select *, len(regexp_extract_all(s, '\p{L}')) as letters, len(list_filter(range(2, length(s)+1), lambda k: regexp_matches(substr(s,k,1),'\p{L}') and regexp_matches(substr(s,k-1,1),'\p{L}') and regexp_matches(substr(s,k,1),'\p{Lu}') <> regexp_matches(substr(s,k-1,1),'\p{Lu}'))) as flips from b)
      select page_id, block_id, length(s) >= 3 and (letters / length(s) < 0.35 or (letters >= 4 and regexp_matches(s,'\p{Lu}') and regexp_matches(s,'\p{Ll}') and flips > length(s) * 0.35)) as noise from c""",
    "tag_target_language": f"""with d as (select doc_id, lang, list_transform(string_split_regex({duck.strip('text')}, '\\s+'), lambda w: regexp_replace({duck.fold('w')}, '^[.,;:!?¿¡()\\[\\]{{}}"'']+|[.,;:!?¿¡()\\[\\]{{}}"'']+$', '', 'g')) as tok from documents)
      select doc_id, case lang {' '.join(f"when '{c}' then list_has_any(tok, {sql_list(w)})" for c, w in lg.COMMON_WORDS.items())} else false end as looks_right from d""",
    "tag_source_leftover": f"""with d as (select doc_id, {LATIN} as tok from documents) select doc_id, {hits_sql(lg.MIXED_MARKERS['en'])} >= 2 and {hits_sql(lg.MIXED_MARKERS['en'])} >= {hits_sql(lg.MIXED_MARKERS['es'])} + 1 as leftover from d""",
    "normalize_text": f"""with d as (select doc_id, {duck.collapse("regexp_replace(" + duck.plain('text') + ", '!\\[\\]\\([^)]*\\)|<\\|[^|]*\\|>', '', 'g')")} as n from documents) select doc_id, length(n) as n, md5(n) as digest from d""",
    "validate_requests": f"""with r as (select doc_id, source, text, case when doc_id % 11 = 0 then 'xx' when doc_id % 11 = 1 then 'en' when lang = 'fr' then 'auto' else lang end as s, case when doc_id % 11 = 3 then 'auto' else 'en' end as t from documents),
      n as (select source, count(*) as n from documents group by 1)
      select doc_id, case when n > 500 then 'batch_too_large' when {duck.strip('text')} = '' then 'blank' when s not in {sql_in(lg.SUPPORTED)} then 'bad_source' when t = 'auto' then 'bad_target' when s <> 'auto' and s = t then 'same_language'
        when length(text) > 20000 then 'too_long' when len(regexp_extract_all(text, '\\S+')) > 5000 then 'too_many_words' end as error from r join n using (source)""",
    "coerce_flags": """select event_id, event_id % 5 = 0 as a, case when event_id % 3 = 1 then true when event_id % 3 = 0 then false else true end as b from events""",
    "document_keys": r"""with p as (select page_id, url, substr(regexp_replace(url, '[^A-Za-z0-9_]', '', 'g'), 1, 64) as c, case when page_id % 4 > 0 then '0.1:' || page_id else '' end as g from pages)
      select page_id, substr(md5(url), 1, 12) as doc_key, substr(sha256(url), 1, 12) as doc_key_sha, md5(url) as doc_md5, sha256(url) as doc_sha256, c as clean_scope, case when c = '' or g = '' then g else c || ':' || g end as scoped_signature from p""",
    "natural_sort_key": r"""select page_id, array_to_string(list_transform(regexp_extract_all(lower(url), '\d+|\D+'), lambda p: case when regexp_matches(p, '^\d') then lpad(length(ltrim(p, '0'))::varchar, 10, '0') || ltrim(p, '0') else p end), '') as sort_key from pages""",
    "page_range": "select l_linenumber as page, count(*) as n from lineitem where l_linenumber between 2 and 4 group by 1",
}
