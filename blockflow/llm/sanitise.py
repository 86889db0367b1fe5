"""Information-theoretic sanitisation of personal data.

Addresses, numbers and the like (the base spans) are the protected entities. A line is a context.
How strongly a term reveals an entity is their pointwise mutual information over all lines of the
corpus; the entity's information content is what there is to disclose. A term that discloses at
least ``DISCLOSED`` of it, in at least ``SUPPORT`` different lines with the entity (copies of a line
count once), gives a span wherever it stands, also in documents without the entity. ``sanitise``
puts a tag for the kind in
place of a base span; a revealing term becomes a general tag where it is written like a name and is
removed otherwise.

Everything is native: counts are combined before the shuffle, terms meet documents by a join, and
a row of 2**20 flags spares documents without any revealing term that shuffle.

Base patterns are the contract's, written so that long runs take linear time: a match can only start
where a run starts or the last match ended, and repetitions do not give characters back.

Defined results: a null text is an empty one and has no spans; repeated rows get spans each for
themselves, and their lines count each; null ids do no harm; extra columns are not read; an empty
table gives an empty result. Spans of different kinds may overlap, terms never overlap base spans.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.llm.common import ascii_lower, let, table
from blockflow.session import checkpointed

DISCLOSED = 0.9
SUPPORT = 3
FLAGS = 1 << 20
BLOCK = 256  # matches of one text that are placed together

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}",
          "phone": r"\+[0-9]"}
KINDS = list(PATTERNS)
_TERM = r"\p{L}{2,}"
_SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0),
                       lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+", "")
            return (F.length(plain) <= 3) & (F.coalesce(
                F.substring(plain, 1, 3).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(14, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _fold(items: Column, reach, combine, kind: str, step) -> Column:
    """What ``step`` puts out when it folds items from a place p on, in blocks of ``BLOCK``.

    ``reach`` gives what a block does to p and ``combine`` adds it, so that an array is only
    appended to while it is short, however many items there are.
    """
    def block(i: Column) -> Column:
        return F.slice(items, i * BLOCK + 1, F.lit(BLOCK))

    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))

    def folded(blocks: Column) -> Column:
        places = F.aggregate(
            F.transform(blocks, reach), F.array(F.lit(0)),
            lambda a, x: F.array_append(a, combine(F.element_at(a, -1), x)))
        return F.flatten(F.zip_with(
            blocks, F.slice(places, F.lit(1), F.size(blocks)), lambda b, p: F.aggregate(
                b, F.struct(p.alias("p"), F.array().cast(kind).alias("out")), step)["out"]))

    return let(F.transform(F.sequence(F.lit(0), last), block), folded)


def _placed(text: Column, pattern: Column, kind: int, valid=None) -> Column:
    """Matches of a pattern with their places: what lies between them gives the distances."""
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
                     F.transform(F.split(text, pattern, -1), F.length).alias("g"))

    def add(a: Column, x: Column) -> Column:
        s = a["p"] + x["g"]
        e = s + F.length(x["m"])
        span = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["m"].alias("m"))
        kept = F.array_append(a["out"], span)
        return F.struct(e.alias("p"), (F.when(valid(x["m"]), kept).otherwise(a["out"])
                                       if valid else kept).alias("out"))

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda a, x: a + x["g"] + F.length(x["m"]))

    return let(found, lambda f: let(
        F.transform(f["m"], lambda m, i: F.struct(m.alias("m"), F.get(f["g"], i).alias("g"))),
        lambda items: _fold(items, length, lambda p, x: p + x, _SPAN, add)))


def base_spans(text: Column) -> Column:
    """Sorted base spans of a text: start, kind, end, match."""
    none = F.array().cast(_SPAN)
    kinds = [F.when(text.contains(_NEEDS[k]) if k == "email" else text.rlike(_NEEDS[k]),
                    _placed(text, F.lit(PATTERNS[k]), i, lambda m, k=k: _valid(k, m)))
             .otherwise(none) for i, k in enumerate(KINDS)]
    return F.sort_array(F.concat(*kinds))


def _terms(line: Column) -> Column:
    """The terms of a line outside of what looks like a base span, in order."""
    blank = line
    for kind in KINDS:
        blank = F.regexp_replace(blank, PATTERNS[kind], " ")
    plain = F.when(line.rlike("[@0-9]"), blank).otherwise(line)
    return F.regexp_extract_all(ascii_lower(plain), F.lit(_TERM), F.lit(0))


def _entity(span: Column) -> Column:
    """What a base span protects: the same address or number in any writing."""
    return F.concat(span["k"].cast("string"), F.lit(":"), F.when(
        span["k"] >= 2, _digits(span["m"])).otherwise(ascii_lower(span["m"])))


def revealing_terms(docs: DataFrame) -> DataFrame:
    """term, entity and bits for the terms that disclose an entity."""
    lines = docs.select(F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
                        .alias("line")).filter(F.length("line") > 0)
    near = checkpointed(
        lines.filter(F.col("line").rlike("[@0-9]"))
        .select("line", F.array_distinct(F.transform(base_spans(F.col("line")), _entity))
                .alias("entities")).filter(F.size("entities") > 0)
        .groupBy("line", "entities").agg(F.count("*").alias("n"))
        .select("n", "entities", F.array_distinct(_terms(F.col("line"))).alias("terms")))
    each = near.select("n", F.explode("entities").alias("entity"), "terms")
    of_entity = each.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    # A row of ``near`` is one different line, so rows are counted, without a hash of the line.
    together = checkpointed(
        each.select("n", "entity", F.explode("terms").alias("term"))
        .groupBy("entity", "term").agg(F.sum("n").alias("n_both"),
                                       F.count("*").alias("support"))
        .filter(F.col("support") >= SUPPORT))
    of_term = lines.select(F.explode(F.array_distinct(_terms(F.col("line")))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n_term"))
    n_lines = lines.count()
    bits = F.log2(F.col("n_both") * F.lit(float(n_lines)) / F.col("n_term") / F.col("n_entity"))
    content = F.log2(F.lit(float(n_lines)) / F.col("n_entity"))
    return checkpointed(
        together.join(of_entity, "entity").join(of_term, "term")
        .select("term", "entity", bits.alias("bits"), content.alias("content"))
        .filter((F.col("content") > 0) & (F.col("bits") >= DISCLOSED * F.col("content")))
        .select("term", "entity", "bits"))


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _place(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FLAGS)).cast("int")


def _word(place: Column) -> Column:
    return F.shiftright(place, 6)


def _flags(terms: DataFrame) -> DataFrame:
    """One row with ``flags``: FLAGS bits in whole numbers of 64, set at the places of the terms.

    They are data and not a constant of the plan, which Spark would write out in full in each
    description of a plan that the driver keeps.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)))
    none = terms.sparkSession.range(FLAGS // 64).select(
        F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = terms.select(_place(F.col("term")).alias("p")).select(
        _word(F.col("p")).alias("word"), bit.alias("bits")).unionByName(none)
    return words.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(
        F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("flags"))


def _term_spans(docs: DataFrame, revealing: DataFrame) -> DataFrame:
    """k1, k2 of a text and the spans of revealing terms in it."""
    terms = revealing.select("term").distinct()
    texts = docs.crossJoin(F.broadcast(_flags(terms)))  # one row of FLAGS bits

    def flagged(term: Column) -> Column:
        return let(_place(term), lambda p: F.getbit(
            F.get("flags", _word(p)), p.bitwiseAND(F.lit(63))) == 1)

    def spans(words: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)(?<!\p{L})(?:"), F.array_join(words, "|"),
                           F.lit(r")(?!\p{L})"))
        return F.when(F.size(words) > 0, _placed(F.col("text"), pattern, len(KINDS)))

    words = F.flatten(F.transform(F.split("text", "\n"), _terms))
    placed = texts.select(*_keys(F.col("text")), F.explode(
        let(F.filter(F.array_distinct(words), flagged), spans)).alias("x"))
    return checkpointed(
        placed.withColumn("term", ascii_lower(F.col("x.m"))).distinct().join(terms, "term")
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_list("x")).alias("found")))


def find_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, base (base spans) and spans (those and the terms'), sorted."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = _term_spans(texts, revealing_terms(texts))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, *_keys(text), base_spans(text).alias("base"))
    terms = F.filter(F.coalesce("found", F.array().cast(_SPAN)), lambda t: ~F.exists(
        "base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return rows.join(found, ["k1", "k2"], "left").select(
        *keep, "base", F.sort_array(F.concat("base", terms)).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def replaced(text: Column, spans: Column) -> Column:
    """The text with tags in place of its spans; of overlapping spans the first gives the tag."""
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def tag(x: Column) -> Column:
        name = F.when(F.substring(x["m"], 1, 1) != ascii_lower(F.substring(x["m"], 1, 1)),
                      F.lit("[NAME]")).otherwise(F.lit(""))
        return F.coalesce(F.get(tags, x["k"]), name)

    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        before = F.substring(text, a["p"] + 1, x["s"] - a["p"])
        return F.struct(F.greatest(a["p"], x["e"]).alias("p"), F.when(
            x["s"] >= a["p"], F.array_append(F.array_append(a["out"], before), tag(x)))
            .otherwise(a["out"]).alias("out"))

    done = let(F.aggregate(spans, start, add), lambda a: F.concat(
        F.array_join(a["out"], ""), F.substring(text, a["p"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    rows = find_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}")
              for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts,
                       F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       _written(F.col("spans")).alias("spans"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: every document with tags in place of its spans."""
    kept = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    rows = find_spans(kept, ["_row"])
    text = replaced(F.col("_row.text"), F.col("spans"))
    return rows.select(*(
        text.alias(c) if c == "text" else
        F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
        F.col("_row")[c].alias(c) for c in docs.columns))


QUERIES = {"op10_personal_data": op10_personal_data}
ORACLES: dict[str, str] = {}
