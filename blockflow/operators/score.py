"""Detectors against gold boxes, readings against each other."""

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockflow.functions import boxes as bx
from blockflow.functions import text as tx
from blockflow.functions.edits import edits as edit_distance
from blockflow.operators import scan
from blockflow.operators.blocks import FEW, TILE, _Near
from blockflow.operators.folds import fold_groups
from blockflow.operators.cells import CELL
from blockflow.operators.joins import covered, prefixed
from blockflow.session import checkpointed

CLASS_NAMES = {0: "bubble", 1: "free"}


def _match(rows: list[dict], min_ratio: float):
    """Gold boxes in turn take the first free detection near them that covers enough."""
    free = {k: r for k, r in enumerate(rows) if not r["_gold"]}
    near = _Near(rows) if len(rows) > FEW else None
    for k, r in free.items() if near else ():
        near.add(k, r)
    hits: Counter = Counter()
    for gold in filter(lambda r: r["_gold"], rows):
        cover = (k for k in (near.of(gold) if near else free) if k in free
                 and bx.overlap_of(gold, free[k]) > min_ratio)
        if (k := next(cover, None)) is not None:
            del free[k]
            hits[gold["cls"]] += 1
    if hits:
        yield (rows[0]["page_id"], hits.total(), hits[0], hits[1])


def page_scores(gold: DataFrame, dets: DataFrame, pages: DataFrame, min_ratio: float = 0.30,
                giant: float = 0.25, tile: int = TILE) -> DataFrame:
    """Hits, misses and extras per page from a greedy one-to-one match.

    Gold boxes in id order each take their first free detection. Boxes that can match overlap,
    so the greedy runs per (page, strip); plain counts come from ordinary aggregation. Boxes and
    page sizes are written once: strips and counts read them several times.
    """
    pages = checkpointed(pages.select("page_id", "page_w", "page_h"))
    both = (gold.select("page_id", F.col("gold_id").alias("_id"), "cls", "x", "y", "w", "h",
                        F.lit(True).alias("_gold"))
            .unionByName(dets.select("page_id", F.col("det_id").alias("_id"), "cls", "x", "y",
                                     "w", "h", F.lit(False).alias("_gold"))))
    both = checkpointed(both)
    cut = scan.strips(both, ["page_id"], F.col("y"), F.col("y") + F.col("h"), tile)
    matched = (fold_groups(cut, ["page_id", "strip"], ["_id"],
                           lambda rows: _match(rows, min_ratio),
                           "page_id bigint, hits bigint, hit_bubble bigint, hit_free bigint")
               .groupBy("page_id").agg(*[F.sum(c).alias(c)
                                         for c in ("hits", "hit_bubble", "hit_free")]))
    sized = both.where("_gold").join(pages, "page_id")
    g = sized.groupBy("page_id").agg(
        F.count("*").alias("gold"), F.count_if(F.col("cls") == 0).alias("gold_bubble"),
        F.count_if(F.col("cls") == 1).alias("gold_free"),
        F.count_if(F.col("w") * F.col("h") > F.col("page_w") * F.col("page_h") * giant)
        .alias("giant"))
    d = both.where("not _gold").groupBy("page_id").agg(F.count("*").alias("detections"))
    zero = F.lit(0).cast("bigint")
    out = pages.select("page_id")
    for part in (g, d, matched):
        out = out.join(part, "page_id", "left")
    out = out.na.fill(0)
    return (out.withColumn("fns", F.col("gold") - F.col("hits"))
            .withColumn("fps", F.col("detections") - F.col("hits"))
            .withColumn("recall", F.when(F.col("gold") == zero, 1.0)
                        .otherwise(F.col("hits") / F.col("gold")))
            .withColumn("precision", F.when(F.col("detections") == zero, 1.0)
                        .otherwise(F.col("hits") / F.col("detections"))))


def score_summary(scores: DataFrame) -> DataFrame:
    """One row: totals, recall, precision, F1, score out of 100, pages lost."""
    sums = ["gold", "detections", "hits", "fns", "fps", "gold_bubble", "hit_bubble", "gold_free",
            "hit_free", "giant"]
    t = scores.agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in sums],
                   F.count_if((F.col("gold") > 0) & (F.col("hits") == 0)).alias("pages_lost"))

    def rate(part: str, whole: str):
        return F.when(F.col(whole) == 0, 1.0).otherwise(F.col(part) / F.col(whole))

    r, p = F.col("recall"), F.col("precision")
    return (t.withColumn("recall", rate("hits", "gold"))
            .withColumn("precision", rate("hits", "detections"))
            .withColumn("f1", F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0))
            .withColumn("recall_bubble", rate("hit_bubble", "gold_bubble"))
            .withColumn("recall_free", rate("hit_free", "gold_free"))
            .withColumn("score", F.bround(r * 100).cast("int")))


def score_detections(gold: DataFrame, dets: DataFrame, pages: DataFrame,
                     min_ratio: float = 0.30) -> DataFrame:
    return score_summary(page_scores(gold, dets, pages, min_ratio))


def worst_pages(scores: DataFrame, n: int = 5) -> DataFrame:
    """The pages with the lowest recall, most gold boxes first among equals."""
    return (scores.select("page_id", "recall", "fns", "gold")
            .orderBy("recall", F.desc("gold"), "page_id").limit(n))


def found_gold(gold: DataFrame, dets: DataFrame, min_ratio: float = 0.30,
               cell: int = CELL) -> DataFrame:
    """Gold boxes that some detection covers."""
    return covered(gold, dets, "gold_id", min_ratio, cell)


def compare_detectors(gold: DataFrame, a: DataFrame, b: DataFrame,
                      min_ratio: float = 0.30) -> DataFrame:
    """Per model: count, mean confidence, class split and share of gold boxes found."""
    keep = ["page_id", "cls", "confidence", "x", "y", "w", "h"]
    both = (a.select(*keep).withColumn("model", F.lit("a"))
            .unionByName(b.select(*keep).withColumn("model", F.lit("b"))))
    seen = (both.groupBy("model").agg(
        F.count("*").alias("detections"),
        F.sum(F.round(F.col("confidence") * 10000).cast("bigint")).alias("_conf"),
        F.count_if(F.col("cls") == 0).alias("bubble"),
        F.count_if(F.col("cls") != 0).alias("free")))
    hit = None
    for model, dets in (("a", a), ("b", b)):
        part = found_gold(gold, dets, min_ratio).agg(F.count("*").alias("found")).withColumn(
            "model", F.lit(model))
        hit = part if hit is None else hit.unionByName(part)
    total = gold.agg(F.count("*").alias("gold"))
    return (seen.join(hit, "model").join(F.broadcast(total))
            .withColumn("mean_confidence", F.col("_conf") / F.col("detections") / 10000)
            .withColumn("recall", F.col("found") / F.col("gold")).drop("_conf"))


def engine_agreement(blocks: DataFrame, first, second) -> DataFrame:
    """Per page: distinct texts both engines read, and those only one read."""
    text = tx.comparable(F.col("text"))
    marks = (blocks.where(F.col("engine").isin(first, second))
             .groupBy("page_id", text.alias("t"))
             .agg(F.max(F.col("engine") == first).alias("a"),
                  F.max(F.col("engine") == second).alias("b")))
    return marks.groupBy("page_id").agg(
        F.count_if("a").alias("texts_first"), F.count_if("b").alias("texts_second"),
        F.count_if(F.col("a") & F.col("b")).alias("both"),
        F.count_if(F.col("a") & ~F.col("b")).alias("only_first"),
        F.count_if(F.col("b") & ~F.col("a")).alias("only_second"))


def agreement_summary(agreement: DataFrame) -> DataFrame:
    """Totals over pages and what the second engine gains, in percent."""
    t = agreement.agg(*[F.sum(c).alias(c) for c in (
        "texts_first", "texts_second", "both", "only_first", "only_second")])
    most = F.greatest("texts_first", "texts_second")
    return t.withColumn("gain_pct", F.when(most > 0, (
        F.col("only_second") - F.col("only_first")) * 100.0 / most))


def error_rate(pairs: DataFrame, by: str = "max", normal=tx.comparable) -> DataFrame:
    """Character error rate of ``hyp`` against ``ref``.

    ``by="max"`` divides by the longer text, ``by="ref"`` by the reference.
    """
    p = tx.once(pairs, _r=normal(F.col("ref")), _h=normal(F.col("hyp")))
    nr, nh = F.length("_r"), F.length("_h")
    edits = edit_distance(F.col("_r"), F.col("_h"))
    if by == "max":
        rate = (F.when((nr == 0) & (nh == 0), 0.0).when((nr == 0) | (nh == 0), 1.0)
                .otherwise(F.col("edits") / F.greatest(nr, nh)))
    else:
        rate = F.col("edits") / F.greatest(F.lit(1), nr)
    return p.withColumn("edits", edits).withColumn("cer", rate).drop("_r", "_h")


BITS = 60  # sources that one number tells apart


def word_recall(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Distinct reference words of each page that each source found.

    ``ref`` is (page_id, text), ``hyp`` is (page_id, source, text).
    """
    kind = hyp.schema["source"].dataType
    both = (hyp.select("page_id", "source", "text", F.lit(False).alias("is_ref"))
            .unionByName(ref.select("page_id", F.lit(None).cast(kind).alias("source"), "text",
                                    F.lit(True).alias("is_ref"))))
    return word_recall_of(both, [r.source for r in hyp.select("source").distinct().collect()])


def word_recall_of(readings: DataFrame, sources: list) -> DataFrame:
    """``word_recall`` of one table (page_id, source, text, is_ref) with all ``sources`` in it.

    A word of a page is one row that says who read it, so what the readings of a page share is
    shuffled once, and a page of any size spreads over its words. A text without words leaves a
    row without a word, which only shows that the source is there.
    """
    kind = readings.schema["source"].dataType
    sources = sources or [None]
    groups = [sources[k:k + BITS] for k in range(0, len(sources), BITS)]
    bits = []  # by groups of sources, who read a word: the reference is the lowest bit
    for some in groups:
        bit = F.when(F.col("is_ref"), F.lit(1))
        for k, s in enumerate(some):
            bit = bit.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(2 << k))
        bits.append(bit.otherwise(0).cast("bigint"))
    words = readings.where(F.col("page_id").isNotNull()).select(
        "page_id", *[b.alias(f"_by{g}") for g, b in enumerate(bits)],
        F.explode_outer(tx.words(tx.comparable(F.col("text")))).alias("word"))
    met = words.groupBy("page_id", "word").agg(
        *[F.bit_or(f"_by{g}").alias(f"_by{g}") for g in range(len(groups))])
    wanted = F.col("word").isNotNull() & (F.col("_by0") % 2 == 1)
    found = []
    for g, some in enumerate(groups):
        for k, s in enumerate(some):
            here = F.col(f"_by{g}").bitwiseAND(F.lit(2 << k)) != 0
            found.append(F.struct(F.lit(s).cast(kind).alias("source"),
                                  F.count_if(wanted & here).alias("found"),
                                  F.max(here).alias("seen")))
    pages = met.groupBy("page_id").agg(F.count_if(wanted).alias("ref_words"), *[
        f.alias(f"_s{k}") for k, f in enumerate(found)])
    marks = [f"_s{k}" for k in range(len(sources))]
    return (pages.where("ref_words > 0").select("page_id", "ref_words", F.inline(F.array(*marks)))
            .where("seen").select("page_id", "source", "ref_words", "found",
                                  (F.col("found") / F.col("ref_words")).alias("recall")))
