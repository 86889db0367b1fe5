"""Whole jobs: readings of pages to clean, fused and translated blocks, and audits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockflow.functions import text as tx
from blockflow.operators import blocks as bl
from blockflow.operators import language as la
from blockflow.operators import memory as me
from blockflow.operators import quality as qu
from blockflow.operators import runs
from blockflow.rules import glossary as gl
from blockflow.session import checkpointed


def clean_text(blocks: DataFrame) -> DataFrame:
    """Glossary and symbols per block; effects keep their marks."""
    c = F.trim("text")
    fixed = tx.strip_symbols(tx.apply_rules(c, gl.BEFORE))
    return blocks.withColumn("_fx", tx.is_effect_translator(c)).withColumn(
        "text", F.when(F.col("_fx"), c).otherwise(fixed)).drop("_fx")


def clean_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Readings of one engine to merged blocks: stamps and margins dropped, texts cleaned, lines
    joined across and down, junk dropped.

    The cleaned blocks and the joined lines are checkpointed: what follows reads them twice, so each
    pattern is looked for once a block. Page sizes are needed twice, too.
    """
    pages = checkpointed(pages)
    kept = bl.drop_margin_noise(bl.drop_watermarks(blocks), pages)
    lines = checkpointed(bl.merge_lines_horizontal(checkpointed(clean_text(kept))))
    return bl.drop_junk_blocks(bl.merge_lines_vertical(lines, pages))[0]


def translate_blocks(blocks: DataFrame, memory: DataFrame, target: str,
                     now: float) -> DataFrame:
    """Blocks (page_id, block_id, doc_id, text, type, confidence) with language, ``method`` and
    ``result`` out of the document's memory; what has no candidate keeps its text.

    Distinct texts are resolved once and joined back to all blocks.
    """
    tagged = la.tag_language_simple(blocks, out="source_lang").withColumn(
        "request", tx.collapse(F.col("text")))
    keys = ["doc_id", "request", "source_lang", "type"]
    asked = (tagged.where(F.col("request") != "").groupBy(*keys)
             .agg(F.max("confidence").alias("confidence"))
             .withColumn("target_lang", F.lit(target)).withColumn("text", F.col("request")))
    found = me.memory_lookup_variant(me.memory_lookup(asked, memory, now), memory, now)
    none = F.lit(None).cast("string")
    resolved = me.resolve_translation(
        found.withColumn("is_mixed", F.lit(False)).withColumns({
            c: none for c in ("cache_result", "mixed_result", "primary_result",
                              "fallback_result", "pivot_result")}))
    # null-safe on the type, which blocks may lack
    answers = resolved.select(*keys, "method", "result").withColumn(
        "_type", F.coalesce("type", F.lit(""))).drop("type")
    return (tagged.withColumn("_type", F.coalesce("type", F.lit("")))
            .join(answers, ["doc_id", "request", "source_lang", "_type"], "left")
            .withColumn("result", F.coalesce("result", "text")).drop("request", "_type"))


def page_report(translated: DataFrame) -> DataFrame:
    """Status of each page of translated blocks."""
    pages = translated.groupBy("page_id").agg(
        F.count("*").alias("n_blocks"),
        F.count_if(F.col("result") != F.col("text")).alias("n_translated"))
    return runs.page_status(pages.withColumn("attempt", F.lit(0)))


def audit(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quality report, consistency conflicts) of translated pairs."""
    return qu.quality_report(pairs), qu.consistency_conflicts(pairs)
