"""Listings, model output, logs, benchmark records, diagnostics and page exports."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.functions import text as tx
from blockflow.operators import scan
from blockflow.operators.texts import natural_key
from blockflow.rules import patterns as pt
from blockflow.session import checkpointed

IMAGES = [".png", ".jpg", ".jpeg", ".webp", ".bmp"]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a folder; only the listing is read, not the content."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path"))


def document_catalog(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, pages) out of file paths.

    Every folder with images is a document, and so is a lone file right below the root. Of
    documents with one name the first by path keeps it, the others are prefixed with their
    parent. Pages are numbered in natural order: the listing is range-partitioned once, and the
    rank is built from partition totals, so a huge folder is numbered in parallel.
    """
    inside = F.regexp_replace(F.col("path"), "^(file:)?/*" + root.strip("/") + "/*", "")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    found = (files.withColumn("_rel", inside).withColumn("_ext", ext)
             .withColumn("_folder", F.regexp_extract("_rel", r"^(.*)/[^/]*$", 1)))
    lone = F.col("_folder") == ""
    kind = (F.when(lone & (F.col("_ext") == ".pdf"), "pdf").when(lone, "imagen")
            .otherwise("carpeta"))
    usable = found.where(F.col("_ext").isin(IMAGES) | (lone & (F.col("_ext") == ".pdf")))
    owner = F.when(lone, F.col("_rel")).otherwise(F.col("_folder"))
    entries = usable.select("path", owner.alias("document"), kind.alias("kind"),
                            natural_key(F.regexp_extract("path", r"([^/]+)$", 1)).alias("_key"))
    docs = entries.groupBy("document", "kind").agg(F.count("*").alias("n_pages"))
    leaf = F.regexp_extract("document", r"([^/]+)$", 1)
    stem = F.regexp_replace(leaf, r"(?<=.)\.[^.]*$", "")
    parent = F.regexp_extract("document", r"([^/]+)/[^/]+$", 1)
    named = docs.withColumn("_name", stem).withColumn("_order", natural_key(F.col("document")))
    firsts = named.groupBy("_name").agg(F.min(F.struct("_order", "document")).alias("_first"))
    named = (named.join(firsts, "_name")
             .withColumn("name", F.when((F.col("_first.document") == F.col("document"))
                                        | (parent == ""), F.col("_name"))
                         .otherwise(F.concat_ws("_", parent, "_name")))
             .select("document", "kind", "name", "n_pages"))
    ranged = checkpointed(entries.repartitionByRange("document", "_key", "path")
                          .withColumn("_part", F.spark_partition_id()))
    pages = scan.rank(ranged, ["document"], ["_key", "path"], "_part", "page").select(
        "document", "page", "path")
    return named, pages


def read_detection_markup(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, pages) out of model output (stream_id, stream, n_images).

    Sections follow ``<PAGE>`` marks and empty ones keep their place. What stands before the
    first mark is dropped unless it already holds tags. ``pages`` has one row per image, also
    where the model stopped early; surplus sections are dropped.
    """
    sections = F.split("stream", "<PAGE>", -1)
    lead = F.contains(F.get(F.col("_s"), F.lit(0)), F.lit("<|det|>")) & (F.size("_s") > 1)
    s = (streams.withColumn("_s", sections)
         .withColumn("_s", F.when(lead, F.col("_s")).otherwise(F.slice(
             "_s", F.lit(2), F.greatest(F.lit(0), F.size("_s") - 1)))))
    secs = (s.select("stream_id", "n_images", F.posexplode("_s").alias("page_no", "section"))
            .where(F.col("page_no") < F.col("n_images")))

    def group(k: int) -> Column:
        return F.regexp_extract_all("section", F.lit(pt.DETECTION_TAG), F.lit(k))

    fields = ["type", "x", "y", "w", "h", "text"]
    zipped = F.arrays_zip(*[group(k).alias(n) for k, n in enumerate(fields, 1)])
    blocks = secs.select("stream_id", "page_no", F.posexplode(zipped).alias("pos", "b")).select(
        "stream_id", "page_no", "pos", F.col("b.type").alias("type"),
        *[F.col(f"b.{c}").cast("bigint").alias(c) for c in "xywh"],
        tx.strip(F.col("b.text")).alias("text"))
    counts = blocks.groupBy("stream_id", "page_no").agg(F.count("*").alias("n_blocks"))
    pages = (streams.select("stream_id", F.explode(F.sequence(
        F.lit(0), F.col("n_images").cast("int") - 1)).alias("page_no"))
        .join(counts, ["stream_id", "page_no"], "left").na.fill(0, ["n_blocks"]))
    return blocks, pages


def rescale_boxes(blocks: DataFrame, canvas: float, pages: DataFrame) -> DataFrame:
    """Boxes from a square canvas to page pixels, sides at least 1 (half to even)."""
    j = blocks.join(pages, "page_id")

    def to(c: str, size: str) -> Column:
        return F.bround(F.col(c) / canvas * F.col(size), 0).cast("bigint")

    one = F.lit(1).cast("bigint")
    return (j.withColumn("x", to("x", "page_w")).withColumn("y", to("y", "page_h"))
            .withColumn("w", F.greatest(one, to("w", "page_w")))
            .withColumn("h", F.greatest(one, to("h", "page_h"))).drop("page_w", "page_h"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, line_no, line); file is the name alone. Files are split by Spark as usual; a
    line's number comes from its place in its split plus the lines of the file's earlier splits."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_in_split"), F.col("value").alias("line"))
    return scan.rank(raw, ["path"], ["_in_split"], "_at", "line_no").drop("_at", "_in_split")


PAGE_RECORD = ("struct<total_s: double, n_blocks: bigint, avg_conf: double, engine: string, "
               "trigger_v42: boolean, trigger_reason: string, vlm_called: boolean, "
               "vlm_recovered: bigint, rapid_aggr_salvaged: boolean, negative_skip_841: boolean, "
               "stages: map<string, double>, calls: map<string, bigint>>")


def read_page_benchmarks(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One row per page of benchmark records (a map of page to record), one record to a line;
    ``whole_files`` is for files that hold one record each, over many lines."""
    docs = (spark.read.schema(f"per_page map<string, {PAGE_RECORD}>")
            .option("multiLine", whole_files).json(path))
    return docs.select(F.explode("per_page").alias("page", "r")).select(
        F.col("page").cast("bigint").alias("page"), "r.*")


def long_form(records: DataFrame) -> DataFrame:
    """Stage seconds and call counts as (page, kind, name, value) rows."""
    stages = records.select("page", F.lit("stage").alias("kind"), F.explode("stages").alias(
        "name", "value"))
    calls = records.select("page", F.lit("call").alias("kind"), F.explode("calls").alias(
        "name", "_v")).select("page", "kind", "name", F.col("_v").cast("double").alias("value"))
    return stages.unionByName(calls)


DIAGNOSTICS = ("schema_version int, ocr_mode string, ocr_lang string, doc_id string, "
               "finished boolean, elapsed_s double, timings map<string, double>, "
               "blocks map<string, bigint>, engine_used string, engines array<string>, "
               "trigger map<string, string>, errors array<string>")


def read_page_diagnostics(spark: SparkSession, path: str, version: int | None = None,
                          whole_files: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, stage rows, error rows) of versioned diagnostics, one to a line or, with
    ``whole_files``, one to a file."""
    docs = spark.read.schema(DIAGNOSTICS).option("multiLine", whole_files).json(path)
    if version is not None:
        docs = docs.where(F.col("schema_version") == version)
    stages = docs.select("doc_id", F.explode("timings").alias("stage", "seconds"))
    errors = docs.select("doc_id", F.posexplode("errors").alias("pos", "error"))
    return docs, stages, errors


def export_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in export form: text, corner box, confidence, engines and detector by source."""
    src = F.lower(F.coalesce(F.col("source"), F.lit("")))

    def words(ws) -> Column:
        return F.array(*[F.lit(w) for w in ws])

    engines, detector = None, None
    for names, used, det in pt.EXPORT_ENGINES:
        test = src.isin(names)
        engines = F.when(test, words(used)) if engines is None else engines.when(test, words(used))
        detector = F.when(test, det) if detector is None else detector.when(test, det)
    return blocks.select(
        "page_id", "block_id", F.col("text").alias("texto"),
        F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("bbox"),
        F.round("confidence", 3).alias("conf"),
        engines.otherwise(words(pt.EXPORT_DEFAULT[0])).alias("motores"),
        detector.otherwise(pt.EXPORT_DEFAULT[1]).alias("detector"))


def write_page_exports(blocks: DataFrame, path: str) -> None:
    """Export rows as JSON and page texts as text, in one folder per document (doc_id)."""
    from blockflow.operators.blocks import page_texts
    rows = export_blocks(blocks).join(blocks.select("page_id", "block_id", "doc_id"),
                                      ["page_id", "block_id"])
    rows.write.mode("overwrite").partitionBy("doc_id").json(path + "/json")
    texts = page_texts(blocks, ("doc_id", "page_id"))
    (texts.select("doc_id", F.concat(F.lit("=== "), F.col("page_id").cast("string"),
                                     F.lit(" ===\n"), "page_text").alias("value"))
     .write.mode("overwrite").partitionBy("doc_id").text(path + "/text"))
