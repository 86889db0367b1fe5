"""Run checkpoints: nested JSON documents of pages and their texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = ("struct<src: string, source: string, tgt: string, translated: string, type: string, "
        "block_type: string, confidence: double, source_lang: string, target_lang: string, "
        "detected_lang: string, engine: string>")
EXTRAS = ["confidence", "engine", "detected_lang"]  # what a text may carry besides
SCHEMA = ("total_pages bigint, pages_done array<bigint>, results array<struct<page: bigint, "
          "status: string, blocks: bigint, translated: bigint, time: double, "
          f"source_lang: string, target_lang: string, texts: array<{TEXT}>>>, ocr_mode string, "
          "source_lang string, target_lang string, last_updated string, run string")


def read_checkpoints(spark: SparkSession, path: str,
                     whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pages, pairs) of documents, one to a line; ``whole_files`` is for files that hold one
    document each, over many lines. Languages come from the text, else its page, else the document; older
    key names are accepted; ``has_metadata`` tells whether a text carries any of its own."""
    docs = (spark.read.schema(SCHEMA).option("multiLine", whole_files).json(path)
            .withColumnsRenamed({"source_lang": "_sl", "target_lang": "_tl"})
            .withColumn("run", F.coalesce("run", F.col("_metadata.file_name"))))
    rows = docs.select("run", "_sl", "_tl", F.explode("results").alias("r")).select(
        "run", "_sl", "_tl", "r.*")
    pages = rows.select("run", "page", "status", F.col("blocks").alias("n_blocks"),
                        F.col("translated").alias("n_translated"), F.col("time").alias(
                            "elapsed_s"))
    t = rows.select("run", "page", "_sl", "_tl", F.col("source_lang").alias("_psl"),
                    F.col("target_lang").alias("_ptl"), F.posexplode("texts").alias("pos", "t"))
    own = [F.nullif(F.col(f"t.{c}"), F.lit("")) for c in
           ("type", "block_type", "source_lang", "target_lang")]
    pairs = t.select(
        "run", "page", F.col("pos").cast("bigint").alias("pos"),
        F.coalesce("t.src", "t.source", F.lit("")).alias("src"),
        F.coalesce("t.tgt", "t.translated", F.lit("")).alias("tgt"),
        F.coalesce("t.source_lang", "_psl", "_sl", F.lit("auto")).alias("source_lang"),
        F.coalesce("t.target_lang", "_ptl", "_tl", F.lit("auto")).alias("target_lang"),
        F.coalesce("t.type", "t.block_type").alias("block_type"),
        *(F.col(f"t.{c}").alias(c) for c in EXTRAS),
        F.coalesce(*own).isNotNull().alias("has_metadata"))
    return pages, pairs


def write_checkpoints(pages: DataFrame, pairs: DataFrame, path: str,
                      pages_per_document: int = 10) -> None:
    """Pages (run, page, …) and their texts as nested documents, one folder per run.

    A run is written as many documents of a few pages each, the way it is saved while it goes
    on, so no task holds a whole run. Only folders of runs in ``pages`` are replaced.
    """
    text = F.struct("pos", F.struct(
        "src", "tgt", F.nullif(F.col("block_type"), F.lit("")).alias("type"),
        F.nullif(F.col("source_lang"), F.lit("")).alias("source_lang"),
        F.nullif(F.col("target_lang"), F.lit("")).alias("target_lang"),
        *(F.col(c) for c in EXTRAS if c in pairs.columns)).alias("t"))
    texts = pairs.groupBy("run", "page").agg(F.transform(
        F.array_sort(F.collect_list(text)), lambda x: x["t"]).alias("texts"))
    result = F.struct("page", "status", F.col("n_blocks").alias("blocks"),
                      F.col("n_translated").alias("translated"), F.col("elapsed_s").alias("time"),
                      "texts")
    part = F.floor(F.col("page") / pages_per_document)
    totals = (["total_pages"] if "total_pages" in pages.columns else [])
    docs = (pages.join(texts, ["run", "page"], "left").groupBy("run", part.alias("_part"))
            .agg(F.array_sort(F.collect_list(result)).alias("results"),
                 *(F.max(c).alias(c) for c in totals))
            .withColumn("pages_done", F.transform("results", lambda r: r["page"]))
            .withColumn("value", F.to_json(F.struct("run", "pages_done", "results",
                                                         *totals))))
    (docs.select("run", "value").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").text(path))
