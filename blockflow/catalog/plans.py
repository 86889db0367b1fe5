"""Whole jobs over ``blocks`` and learned memory."""

from pyspark.sql import functions as F

from blockflow.catalog.memory import NOW, memory
from blockflow.plans import pages as pl


def term_blocks(fx):
    """Terms of the memory as blocks of pages, some with a glyph replaced."""
    e = fx.memory_events
    text = F.when(F.col("event_id") % 4 == 1, F.concat(F.substring("source", 1, 2), F.lit("村"))
                  ).otherwise(F.col("source"))
    return e.select((F.col("event_id") % 500).alias("page_id"), F.col("event_id")
                    .alias("block_id"), "doc_id", text.alias("text"), F.lit("text").alias("type"),
                    F.col("quality").alias("confidence"))


def term_memory(fx):
    return memory(fx).withColumn("source_lang", F.lit("zh")).where(
        F.substring("source_key", 3, 1).isin("田", "先"))


QUERIES = {
    "clean_pages": lambda fx: pl.clean_pages(fx.blocks.where("engine = 0"), fx.page_sizes),
    "translate_blocks": lambda fx: pl.translate_blocks(
        term_blocks(fx), term_memory(fx), "es", NOW).groupBy("source_lang", "method").agg(
        F.count("*").alias("n"), F.count_if(F.col("result") != F.col("text")).alias("changed")),
    "page_report": lambda fx: pl.page_report(pl.translate_blocks(
        term_blocks(fx), term_memory(fx), "es", NOW)),
}
ORACLES = {}
