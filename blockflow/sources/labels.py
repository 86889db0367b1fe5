"""Annotation files: one box per line, ``class cx cy w h`` in page units."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.functions import text as tx

CLASSES = ["text_bubble", "text_free"]


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(page, path, line) of all label files below a folder. The page is the file's own name, or
    the value of the folder ``page_id=…`` in files that ``write_labels`` made."""
    files = spark.read.option("recursiveFileLookup", True).text(path)
    path = F.col("_metadata.file_path")
    folder = F.url_decode(F.regexp_extract(path, "/page_id=([^/]+)/", 1))
    return files.select(
        F.coalesce(F.nullif(folder, F.lit("")), F.regexp_extract(path, r"([^/]+)\.txt$", 1))
        .alias("page"), path.alias("path"), F.col("value").alias("line"))


def parse_labels(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes, rejects with ``reason``); blank lines and comments are neither."""
    text = F.trim(F.col("line"))
    parts = F.split(text, r"\s+")

    def number(k: int) -> Column:
        return F.get(F.col("_parts"), F.lit(k)).try_cast("double")

    names = ["_cls", "cx", "cy", "w", "h"]
    p = tx.once(lines.where((text != "") & ~text.startswith("#")), _parts=parts)
    p = tx.once(p, **{n: number(k) for k, n in enumerate(names)})
    numeric = F.lit(True)
    inside = F.lit(True)
    for n in names:
        numeric = numeric & F.col(n).isNotNull()
    for n in names[1:]:
        inside = inside & F.col(n).between(0.0, 1.0)
    reason = (F.when(F.size("_parts") != 5, "arity").when(~numeric, "not_numeric")
              .when(~F.col("_cls").cast("int").isin(*range(len(CLASSES))), "class")
              .when(~inside, "range"))
    judged = tx.once(p, reason=reason)
    boxes = judged.where(F.col("reason").isNull()).select(
        *[c for c in lines.columns if c != "line"], F.col("_cls").cast("int").alias("cls"),
        *names[1:])
    return boxes, judged.where(F.col("reason").isNotNull()).select(*lines.columns, "reason")


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_labels(read_label_lines(spark, path))


def to_pixels(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Centre-normalised boxes to pixel corners; page sizes join on the page."""
    pw, ph = F.col("page_w"), F.col("page_h")
    return (boxes.join(pages, "page_id")
            .withColumn("x", (F.col("cx") - F.col("w") / 2) * pw)
            .withColumn("y", (F.col("cy") - F.col("h") / 2) * ph)
            .withColumn("w", F.col("w") * pw).withColumn("h", F.col("h") * ph)
            .drop("cx", "cy", "page_w", "page_h"))


def label_line(boxes: DataFrame) -> DataFrame:
    """Add ``line`` with six decimals."""
    return boxes.withColumn("line", F.format_string(
        "%d %.6f %.6f %.6f %.6f", F.col("cls").cast("int"), "cx", "cy", "w", "h"))


def write_labels(boxes: DataFrame, pages: DataFrame, path: str) -> None:
    """Label lines by split and page, the class list, and a manifest.

    ``pages`` (page_id, split) also lists pages without boxes; those have a manifest row with
    zero labels and one empty line, which stands for an empty file.
    """
    lines = label_line(boxes).select("page_id", "line")
    full = (pages.join(lines, "page_id", "left").withColumn("line", F.coalesce("line", F.lit(""))))
    full.select("line", "split", "page_id").write.mode("overwrite").partitionBy(
        "split", "page_id").text(path + "/labels")
    counts = lines.groupBy("page_id").agg(F.count("*").alias("n_labels"))
    (pages.join(counts, "page_id", "left").na.fill(0, ["n_labels"])
     .write.mode("overwrite").json(path + "/manifest"))
    spark = boxes.sparkSession
    spark.createDataFrame([(c,) for c in CLASSES], "value string").coalesce(1).write.mode(
        "overwrite").text(path + "/classes")


def merge_corrections(base: DataFrame, corrections: DataFrame, corrected_pages: DataFrame,
                      known: DataFrame) -> DataFrame:
    """Labels with corrections applied.

    Corrected pages replace theirs (an empty correction leaves a page without boxes), untouched
    pages stay, pages the base does not know enter ``train``. ``known`` is (page_id, split).
    """
    touched = corrected_pages.select("page_id").distinct()
    kept = base.join(touched, "page_id", "left_anti")
    merged = kept.unionByName(corrections.join(touched, "page_id", "left_semi"))
    return (merged.join(known.select("page_id", "split"), "page_id", "left")
            .withColumn("split", F.coalesce("split", F.lit("train"))))


def correction_summary(base: DataFrame, corrections: DataFrame, corrected_pages: DataFrame,
                       known: DataFrame) -> DataFrame:
    """One row: pages corrected, new, emptied; labels before and after."""
    touched = corrected_pages.select("page_id").distinct()
    before = base.groupBy("page_id").agg(F.count("*").alias("_before"))
    after = corrections.groupBy("page_id").agg(F.count("*").alias("_after"))
    j = (touched.join(known.select("page_id", F.lit(True).alias("_known")), "page_id", "left")
         .join(before, "page_id", "left").join(after, "page_id", "left")
         .na.fill(0, ["_before", "_after"]))
    old = F.col("_known").isNotNull()
    return j.agg(F.count_if(old).alias("corrected"), F.count_if(~old).alias("new"),
                 F.count_if(old & (F.col("_after") == 0)).alias("emptied"),
                 F.sum(F.when(old, F.col("_before")).otherwise(0)).alias("labels_before"),
                 F.sum("_after").alias("labels_after"))
