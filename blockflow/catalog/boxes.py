"""Box algebra over ``blocks``, ``gold``, ``dets`` and ``regions``."""

from pyspark.sql import functions as F

from blockflow.catalog import duck
from blockflow.catalog.duck import sql_in
from blockflow.fixtures import cte
from blockflow.functions.edits import edits
from blockflow.operators import blocks as b
from blockflow.operators import joins as j
from blockflow.operators import score as sc
from blockflow.rules import patterns as pt

WEIGHTS = {0: 1.0, 1: 0.9, 2: 1.1}
BOX = ["x", "y", "w", "h"]


def raw_readings(fx):
    """Engine 0 as polygons, the others as boxes; some confidences are broken strings."""
    poly = F.expr("array(array(double(x), double(y)), array(double(x + w), double(y)), "
                  "array(double(x + w), double(y + h)), array(double(x), double(y + h)))")
    return fx.blocks.select(
        "page_id", "block_id", F.when(F.col("engine") == 0, poly).alias("polygon"), *BOX, "text",
        F.when(F.col("i") % 13 == 5, "bad").when(F.col("i") % 13 == 6, "NaN")
        .otherwise(F.col("confidence").cast("string")).alias("conf"),
        F.when(F.col("i") % 2 == 0, F.lit(None)).otherwise(F.col("h")).alias("font_size"))


def engine(fx, e, prefix):
    return j.prefixed(fx.blocks.where(F.col("engine") == e).select(
        "page_id", "block_id", *BOX, "text"), prefix)


def sized(fx):
    """Blocks moved over the page borders, some of them images or footers."""
    return fx.blocks.withColumn("x", F.col("x") - 40).withColumn("w", F.col("w") * 2).withColumn(
        "h", F.when(F.col("i") % 9 == 4, F.col("h") * 200).otherwise(F.col("h"))).withColumn(
        "type", F.when(F.col("i") % 9 == 4, "image").when(F.col("i") % 9 == 5, "footer")
        .otherwise(F.col("type")))


SIZED = cte("page_sizes") + """, sized as (select page_id, block_id, x - 40 as x, y, w * 2 as w,
  case when i % 9 = 4 then h * 200 else h end as h, text,
  case when i % 9 = 4 then 'image' when i % 9 = 5 then 'footer' else type end as type from blocks),
clipped as (select page_id, block_id, greatest(0, x) as cx, greatest(0, y) as cy,
   least(page_w, x + w) - greatest(0, x) as cw, least(page_h, y + h) - greatest(0, y) as ch,
   text, type, page_w, page_h
  from sized join page_sizes using (page_id)
  where w > 0 and h > 0 and x + w > 0 and y + h > 0 and x < page_w and y < page_h)
"""


def shifted(fx):
    """A second detector: engine 1, drifting further with the line number."""
    return fx.blocks.where("engine = 1").select(
        "page_id", F.col("i").alias("det_id"), (F.col("i") % 2).alias("cls"),
        (F.col("x") + F.col("i") % 5 * 60).alias("x"), "y", "w", "h", "confidence")


def overlap(a: str, c: str) -> str:
    return (f"(least({a}.x+{a}.w, {c}.x+{c}.w) - greatest({a}.x, {c}.x)) * "
            f"(least({a}.y+{a}.h, {c}.y+{c}.h) - greatest({a}.y, {c}.y)) / "
            f"least({a}.w*{a}.h, {c}.w*{c}.h)")


def touches(a: str, c: str) -> str:
    return (f"{a}.page_id = {c}.page_id and {a}.x < {c}.x + {c}.w and {c}.x < {a}.x + {a}.w "
            f"and {a}.y < {c}.y + {c}.h and {c}.y < {a}.y + {a}.h")


SHORT = "substr(text, 1, 1 + cast(i % 6 as int))"
# Merged pieces of a few characters, digits or symbols: what the junk rules are about.
PIECE = f"case i % 5 when 0 then text when 1 then {SHORT} when 2 then cast(i as varchar(8)) " \
        f"when 3 then concat(cast(i % 10 as varchar(8)), 'a') else '--' end"
CANON = """case when regexp_matches(k, 'title|chapter|heading') then 'title'
 when regexp_matches(k, 'header|caption|narrat|cartel') then 'header'
 when regexp_matches(k, 'sfx|sound|onomat') then 'sfx' when regexp_matches(k, 'thought|thinking') then 'thought'
 when regexp_matches(k, 'dialog|speech|bubble|balloon') then 'dialogue' else 'text' end"""
NOISE = r"""(length(t) >= 2 and not regexp_matches(t, '(?i)^\d+(?:st|nd|rd|th)$') and (
   len(regexp_extract_all(t, '\p{Nd}')) / length(t) > 0.30
   or (regexp_matches(t, '\d{2,}') and (not regexp_matches(t, '\p{L}') or len(regexp_extract_all(t, '\p{L}')) / length(t) < 0.4))
   or regexp_matches(t, '[@#$%^&*+=<>{}|\\/]{2,}')
   or (length(t) >= 5 and len(list_filter(range(1, length(t) - 3), lambda k: len(list_distinct(string_split(upper(substr(t, k, 5)), ''))) = 1)) > 0
       and regexp_matches(regexp_replace(upper(t), '\P{L}', '', 'g'), '^(A*|E*|I*|O*|U*|H*)$'))
   or len(regexp_extract_all(t, '[^\x00-\x7fáéíóúñüÁÉÍÓÚÑÜ¿¡]')) >= 2
   or (length(t) <= 3 and not regexp_matches(lower(t), '[aeiouáéíóúü]') and not regexp_matches(t, '\p{Nd}') and lower(t) not in ('dr','mr','sr','st','jr','vs','tv','cd','pc','ok','km','wc'))))"""

QUERIES = {
    "normalize_blocks": lambda fx: b.normalize_blocks(raw_readings(fx)).select(
        "page_id", "block_id", *BOX, "text", "confidence", "font_size"),
    "clip_blocks": lambda fx: b.clip_blocks(sized(fx), fx.page_sizes)[0].select(
        "page_id", "block_id", *BOX, "type", "font_size"),
    "clip_blocks_panels": lambda fx: b.clip_blocks(sized(fx), fx.page_sizes, 0.02)[1],
    "filter_regions": lambda fx: b.filter_regions(fx.regions, fx.page_sizes).select(
        "page_id", "region_id", "label"),
    "drop_watermarks": lambda fx: b.drop_watermarks(fx.blocks.withColumn("text", F.when(
        F.col("i") % 17 == 3, F.concat("text", F.lit(" htps: abc"))).otherwise(F.col("text"))))
    .groupBy("page_id").agg(F.count("*").alias("kept")),
    "drop_margin_noise": lambda fx: b.drop_margin_noise(fx.blocks.withColumn(
        "text", F.when(F.col("i") % 7 == 2, F.concat(F.lit("12/0"), F.col("i") % 9,
                                                    F.lit("/2024"))).otherwise(F.col("text"))),
        fx.page_sizes).groupBy("page_id").agg(F.count("*").alias("kept"),
                                              F.sum("block_id").alias("ids")),
    "drop_junk_blocks": lambda fx: b.drop_junk_blocks(fx.blocks.withColumn(
        "text", F.expr(PIECE)))[1].select("page_id", "block_id", "drop_reason"),
    "canonical_type": lambda fx: b.canonical_type(fx.blocks).groupBy("type").agg(
        F.count("*").alias("n")),
    "estimate_confidence": lambda fx: b.estimate_confidence(fx.blocks.select(
        "page_id", "block_id", F.col("i"), F.expr(PIECE).alias("text"),
        b.type_of(F.col("type")).alias("type"), (F.col("i") % 8 == 1).alias("from_art_recrop"),
        F.col("h").alias("font_size"))).select(
        "page_id", "block_id", F.round(F.col("confidence") * 1000).cast("bigint")
        .alias("confidence")),
    "block_score": lambda fx: b.block_score(b.canonical_type(fx.blocks), WEIGHTS).select(
        "page_id", "block_id", F.round(F.col("score") * 100000).cast("bigint").alias("score")),
    "overlap_join": lambda fx: j.overlap_join(
        engine(fx, 0, "a_"), engine(fx, 1, "b_"), 0.40).select(
        "page_id", "a_block_id", "b_block_id", "ratio",
        edits(F.col("a_text"), F.col("b_text")).alias("edits")),
    "uncovered": lambda fx: j.uncovered(fx.regions, fx.blocks.where("engine = 0 and i % 4 <> 2"),
                                        0.50).select("page_id", "region_id"),
    "inherit_label": lambda fx: j.inherit_label(fx.blocks, fx.regions).select(
        "page_id", "block_id", "cls"),
    "assign_to_bands": lambda fx: j.assign_to_bands(
        fx.blocks.where("engine = 1").select(F.col("page_id").alias("strip_id"), "block_id",
                                             *BOX),
        fx.blocks.where("engine = 0").select(
            F.col("page_id").alias("strip_id"), F.col("i").alias("item_id"),
            F.col("y").alias("top"), (F.col("h") - F.col("i") % 3 * 4).alias("height"))).select(
        "strip_id", "block_id", "item_id", "y"),
    "merge_lines_horizontal": lambda fx: b.merge_lines_horizontal(fx.blocks),
    "merge_lines_vertical": lambda fx: b.merge_lines_vertical(
        fx.blocks.where("engine = 0"), fx.page_sizes),
    "group_text_lines": lambda fx: b.group_text_lines(
        fx.blocks.where("engine = 0").withColumn("font_size", F.col("h"))),
    "fuse_sources": lambda fx: b.fuse_sources(fx.blocks, WEIGHTS),
    "suppress_boxes": lambda fx: b.suppress_boxes(fx.dets.unionByName(
        shifted(fx).withColumn("det_id", F.col("det_id") + 100000))),
    "label_candidates": lambda fx: b.label_candidates(fx.blocks, fx.regions, fx.page_sizes).select(
        "page_id", "block_id", "cls", "cx", "cy", "wn", "hn"),
    "clean_labels": lambda fx: b.clean_labels(fx.blocks, fx.regions, fx.page_sizes),
    "page_texts": lambda fx: b.page_texts(fx.blocks.where("engine = 0")),
    "reading_order": lambda fx: b.reading_order(fx.blocks, 1024).select(
        "page_id", "block_id", "position"),
    "score_detections": lambda fx: sc.score_detections(fx.gold, fx.dets, fx.page_sizes),
    "worst_pages": lambda fx: sc.worst_pages(sc.page_scores(fx.gold, fx.dets, fx.page_sizes)),
    "existence_recall": lambda fx: sc.found_gold(fx.gold, fx.dets).groupBy("page_id").agg(
        F.count("*").alias("found")),
    "compare_detectors": lambda fx: sc.compare_detectors(fx.gold, fx.dets, shifted(fx)),
    "engine_agreement": lambda fx: sc.engine_agreement(fx.blocks, 0, 1),
    "agreement_summary": lambda fx: sc.agreement_summary(sc.engine_agreement(fx.blocks, 0, 1)),
    "error_rate": lambda fx: sc.error_rate(
        fx.blocks.where("engine = 0").select("page_id", "i", F.col("text").alias("ref")).join(
            fx.blocks.where("engine = 1").select("page_id", "i", F.col("text").alias("hyp")),
            ["page_id", "i"])).select("page_id", "i", "edits", "cer"),
    "word_recall": lambda fx: sc.word_recall_of(fx.blocks.select(
        "page_id", F.col("engine").alias("source"), "text", (F.col("engine") == 0).alias("is_ref")),
        [e for e in WEIGHTS if e != 0]),
}

ORACLES = {
    "normalize_blocks": cte("blocks") + rf"""select page_id, block_id, x, y, w, h, {duck.strip('text')} as text, conf as confidence,
       case when engine = 0 or i % 2 = 0 then greatest(8, cast(floor(h * 0.75) as bigint)) else h end as font_size
      from (select *, case when i % 13 in (5, 6) then null else confidence end as conf from blocks)
      where {duck.strip('text')} <> '' and conf >= 0.08 and w >= 3 and h >= 3""",
    "clip_blocks": SIZED + f"""select page_id, block_id, cx as x, cy as y, cw as w, ch as h, type,
       greatest(10, cast(floor(ch * 0.8) as bigint)) as font_size from clipped
      where cw >= 3 and ch >= 3 and text <> '' and type not in {sql_in(pt.NOISE_TYPES)}""",
    "clip_blocks_panels": SIZED + """select page_id, cx as x, cy as y, cw as w, ch as h from clipped
      where cw >= 3 and ch >= 3 and type = 'image' and cw * ch >= page_w * page_h * 0.02""",
    "filter_regions": cte("regions", "page_sizes") + f"""select page_id, region_id, label from regions join page_sizes using (page_id)
      where w >= 8 and h >= 8 and w * h >= page_w * page_h * 0.0015
        and ({' or '.join(f"contains(lower(label), '{k}')" for k in pt.REGION_KEYWORDS)})
      qualify row_number() over (partition by page_id order by region_id) <= 40""",
    "drop_watermarks": cte("blocks") + r"""select page_id, count(*) as kept from (select page_id,
         case when i % 17 = 3 then text || ' htps: abc' else text end as t from blocks)
      where not regexp_matches(t, '(?i)zonaolympus[\s-]?com|\b1\s*[\s-]?c\s*[\s-]?2\s*[\s-]?e\b|\bhtps?\s*[:\s/''"\\]|[a-z]+[_''"\s]\s*(com|net|org|xyz|io)([^\p{L}\p{N}_]|$)')
      group by page_id""",
    "drop_margin_noise": cte("page_sizes") + r""", t as (select page_id, block_id, y, h, page_h,
         regexp_replace(case when i % 7 = 2 then '12/0' || (i % 9) || '/2024' else text end, '^\s+|\s+$', '', 'g') as t from blocks join page_sizes using (page_id)),
       f as (select *, y + h / 2 < page_h * 0.085 or y + h / 2 > page_h * 0.955 as margin,
         regexp_matches(t, '(?i)\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{1,2}[/.\-]\d{1,2}1?\d{2}\b|\d{1,2}[:.]\d{2}\s*([ap]\.?\s?m\.?)?|^\d{1,4}\s*/\s*\d{1,4}$|\b\d{1,4}\s+de\s+\d{1,4}\b|\bp[aá]g(ina)?\.?\s?\d{1,4}\b|\b(p[aá]g(ina)?|page)\s+\d+\s+(de|of)\s+\d+\b|\b\d{8,14}[A-Za-z0-9_\-]*\b|\b\d{1,6}\s*[,.]?\s*\d{1,4}\s*p\.?m\.?\b|\b\d{1,4}\s*p\.?m\.?\b') as noise,
         length(t) > 0 and len(regexp_extract_all(t, '\p{Nd}')) >= 0.35 * length(t) and len(regexp_extract_all(t, '\S+')) <= 4 as digits from t)
      select page_id, count(*) as kept, sum(block_id)::bigint as ids from f
      where not (margin and (noise or digits)) and not regexp_matches(t, '(?i)https?://|www\.|\.(com|net|org|xyz|io)([^\p{L}\p{N}_]|$)')
      group by page_id""",
    "drop_junk_blocks": cte("blocks") + rf""", t as (select page_id, block_id, w, h, confidence as conf, {duck.strip(PIECE)} as t from blocks)
      select * from (select page_id, block_id, case when t = '' then 'empty'
        when conf < 0.35 and {NOISE} then 'noise'
        when regexp_matches(t, '^\d+$') then 'number'
        when regexp_matches(t, '^[\d\s.,;:!?%''"\-–—/\\]+$') then 'number_pattern'
        when regexp_matches(t, '^["'']+\d') and length(t) <= 6 then 'quote_number'
        when regexp_matches(t, '^[~''"\-–—:;,.!¡¿?=]+$') and length(t) <= 2 then 'punctuation'
        when w / h < 0.4 and length(t) <= 3 then 'narrow'
        when length(t) = 1 and conf < 0.25 then 'lone_character'
        when conf < 0.15 and length(t) <= 3 then 'short_low_confidence'
        when length(t) <= 3 and regexp_matches(t, '^\d+[a-zA-Z]?$') then 'digit_letter' end as drop_reason from t)
      where drop_reason is not null""",
    "canonical_type": cte("blocks") + f"select {CANON} as type, count(*) as n from (select replace(lower(type), '-', '_') as k from blocks) group by 1",
    "estimate_confidence": cte("blocks") + rf""", t as (select page_id, block_id, i, h, {PIECE} as text, {CANON} as type from (select *, replace(lower(type), '-', '_') as k from blocks)),
      u as (select *, case when type in ('text','title') then 0.90::double when type = 'header' then 0.70::double else 0.80::double end as base,
         len(regexp_extract_all(text, '\p{{L}}')) as letters, len(regexp_extract_all(text, '[aeiouáéíóúAEIOUÁÉÍÓÚ]')) as vowels from t),
      v as (select *, case when letters = 0 then base * 0.5::double when length(text) <= 2 then base * 0.7::double when vowels / letters >= 0.25 then base + 0.05::double else base end as c from u),
      w as (select *, case when i % 8 = 1 then greatest(c, 0.80::double) else c end + case when h between 10 and 40 then 0.03::double else 0 end as d from v)
      select page_id, block_id, cast(round(round(least(1.0::double, d), 4) * 1000) as bigint) as confidence from w""",
    "block_score": cte("blocks") + f"""select page_id, block_id, cast(round(confidence * case {CANON} when 'title' then 1.15::double when 'header' then 1.05::double else 1.0::double end
        * least(2.0::double, greatest(0.5::double, length({duck.strip('text')}) / 5.0::double)) * case engine when 0 then 1.0::double when 1 then 0.9::double else 1.1::double end * 100000) as bigint) as score
      from (select *, replace(lower(type), '-', '_') as k from blocks)""",
    "overlap_join": cte("blocks") + f"""select a.page_id, a.block_id as a_block_id, c.block_id as b_block_id, {overlap('a', 'c')} as ratio, levenshtein(a.text, c.text) as edits
      from blocks a join blocks c on a.engine = 0 and c.engine = 1 and {touches('a', 'c')} where {overlap('a', 'c')} > 0.40""",
    "uncovered": cte("regions") + f"""select page_id, region_id from regions r where not exists (
      select 1 from blocks k where k.engine = 0 and k.i % 4 <> 2 and {touches('r', 'k')} and {overlap('r', 'k')} > 0.50)""",
    "inherit_label": cte("regions") + f""", kc as (select *, unnest(range(floor(x / 512)::bigint, greatest(ceil((x + w) / 512)::bigint, floor(x / 512)::bigint + 1))) as gx from blocks),
        k as (select *, unnest(range(floor(y / 512)::bigint, greatest(ceil((y + h) / 512)::bigint, floor(y / 512)::bigint + 1))) as gy from kc),
        rc as (select *, unnest(range(floor(x / 512)::bigint, greatest(ceil((x + w) / 512)::bigint, floor(x / 512)::bigint + 1))) as gx from regions),
        r as (select *, unnest(range(floor(y / 512)::bigint, greatest(ceil((y + h) / 512)::bigint, floor(y / 512)::bigint + 1))) as gy from rc),
        best as (select k.page_id, k.block_id, arg_max(r.label, ({overlap('k', 'r')}) * 1e7 - r.region_id) as label
        from k join r on k.page_id = r.page_id and k.gx = r.gx and k.gy = r.gy
        where {touches('k', 'r')} and {overlap('k', 'r')} > 0.30 group by 1, 2)
      select blocks.page_id, blocks.block_id, cast(case when label is not null then contains(lower(label), 'free') else type in ('title','header') end as int) as cls
      from blocks left join best using (page_id, block_id)""",
    "assign_to_bands": cte("blocks") + """select l.page_id as strip_id, l.block_id, k.i as item_id, l.y - k.y as y from blocks l join blocks k
      on l.engine = 1 and k.engine = 0 and l.page_id = k.page_id and floor(l.y + l.h / 2) >= k.y and floor(l.y + l.h / 2) < k.y + k.h - k.i % 3 * 4""",
    "label_candidates": cte("regions", "page_sizes") + f""", best as (select k.page_id, k.block_id, arg_max(r.label, ({overlap('k', 'r')}) * 1e7 - r.region_id) as label
        from blocks k join regions r on {touches('k', 'r')} where {overlap('k', 'r')} > 0.30 group by 1, 2)
      select k.page_id, k.block_id, cast(case when label is not null then contains(lower(label), 'free') else type in ('title','header') end as int) as cls,
        least(greatest((x + w / 2) / page_w, 0), 1) as cx, least(greatest((y + h / 2) / page_h, 0), 1) as cy, least(w / page_w, 1) as wn, least(h / page_h, 1) as hn
      from blocks k join page_sizes using (page_id) left join best using (page_id, block_id)
      where w >= 15 and h >= 12 and w * h <= page_w * page_h * 0.6 and x + w <= page_w * 1.5 and y + h <= page_h * 1.5""",
    "page_texts": cte("blocks") + "select page_id, string_agg(text, chr(10) order by y, x, block_id) as page_text from blocks where engine = 0 and trim(text) <> '' group by page_id",
    "reading_order": cte("blocks") + "select page_id, block_id, row_number() over (partition by page_id order by y, x, block_id) as position from blocks",
    "existence_recall": cte("gold", "dets") + f"select page_id, count(*) as found from gold g where exists (select 1 from dets d where {touches('g', 'd')} and {overlap('g', 'd')} > 0.30) group by page_id",
    "compare_detectors": cte("gold", "dets") + f""", models as (select 'a' as model, page_id, cls, x, y, w, h, confidence from dets
        union all select 'b', page_id, i % 2, x + i % 5 * 60, y, w, h, confidence from blocks where engine = 1),
      hits as (select m.model, count(distinct (g.page_id, g.gold_id)) as found from gold g join models m on {touches('g', 'm')} where {overlap('g', 'm')} > 0.30 group by 1)
      select model, count(*) as detections, count(*) filter (cls = 0) as bubble, count(*) filter (cls <> 0) as free, any_value(found) as found,
        (select count(*) from gold) as gold, sum(cast(round(confidence * 10000) as bigint)) / count(*) / 10000 as mean_confidence,
        any_value(found) / (select count(*) from gold) as recall from models join hits using (model) group by model""",
    "engine_agreement": cte("blocks") + f""", m as (select page_id, {duck.collapse(duck.plain('text'))} as t, bool_or(engine = 0) as a, bool_or(engine = 1) as b from blocks where engine in (0, 1) group by 1, 2)
      select page_id, count(*) filter (a) as texts_first, count(*) filter (b) as texts_second, count(*) filter (a and b) as both, count(*) filter (a and not b) as only_first, count(*) filter (b and not a) as only_second from m group by page_id""",
    "agreement_summary": cte("blocks") + f""", m as (select page_id, {duck.collapse(duck.plain('text'))} as t, bool_or(engine = 0) as a, bool_or(engine = 1) as b from blocks where engine in (0, 1) group by 1, 2),
      s as (select count(*) filter (a) as texts_first, count(*) filter (b) as texts_second, count(*) filter (a and b) as both, count(*) filter (a and not b) as only_first, count(*) filter (b and not a) as only_second from m)
      select *, (only_second - only_first) * 100.0::double / greatest(texts_first, texts_second) as gain_pct from s""",
    "error_rate": cte("blocks") + f""", t as (select a.page_id, a.i, {duck.collapse(duck.plain('a.text'))} as r, {duck.collapse(duck.plain('c.text'))} as h from blocks a join blocks c on a.page_id = c.page_id and a.i = c.i and a.engine = 0 and c.engine = 1)
      select page_id, i, levenshtein(r, h) as edits, case when r = '' and h = '' then 0.0 when r = '' or h = '' then 1.0 else levenshtein(r, h) / greatest(length(r), length(h)) end as cer from t""",
    "word_recall": cte("blocks") + f""", w as (select distinct page_id, engine, unnest(string_split({duck.collapse(duck.plain('text'))}, ' ')) as word from blocks),
      v as (select * from w where word <> ''), r as (select page_id, count(*) as ref_words from v where engine = 0 group by 1),
      s as (select distinct page_id, engine as source from blocks where engine <> 0),
      f as (select h.page_id, h.engine as source, count(*) as found from v h join v r on r.engine = 0 and h.engine <> 0 and r.page_id = h.page_id and r.word = h.word group by 1, 2)
      select page_id, source, ref_words, coalesce(found, 0) as found, coalesce(found, 0) / ref_words as recall from r join s using (page_id) left join f using (page_id, source)""",
}
