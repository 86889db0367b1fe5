"""Users, projects, pages and text blocks as tables, with the owner as scope."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "users": "id bigint, supabase_uid string, username string, email string, "
             "created_at timestamp, is_active boolean",
    "projects": "id bigint, user_id bigint, name string, source_lang string, target_lang string, "
                "file_type string, total_pages bigint, created_at timestamp, "
                "updated_at timestamp",
    "pages": "id bigint, project_id bigint, page_number bigint, original_image string, "
             "inpainted_image string, status string, created_at timestamp",
    "text_blocks": "id bigint, page_id bigint, x bigint, y bigint, w bigint, h bigint, "
                   "source_text string, translated_text string, confidence double, "
                   "font_size bigint, text_color string, bg_color string, polygon string, "
                   "is_edited boolean, created_at timestamp, page_bucket bigint",
}
DEFAULTS = {"projects": {"source_lang": "auto", "target_lang": "en", "total_pages": 0},
            "pages": {"status": "pending"},
            "text_blocks": {"source_text": "", "translated_text": "", "confidence": 0.0,
                            "font_size": 12, "text_color": "#ffffff", "bg_color": "#000000",
                            "is_edited": False}}
BUCKETS = 256


def conform(df: DataFrame, table: str, buckets: int = BUCKETS) -> DataFrame:
    """A table in its declared columns and types, defaults filled in."""
    from blockflow.operators.folds import schema_of
    if table == "text_blocks":
        df = df.withColumn("page_bucket", F.pmod("page_id", F.lit(buckets)))
    have = set(df.columns)
    default = DEFAULTS.get(table, {})
    out = []
    for f in schema_of(SCHEMAS[table]).fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        c = F.coalesce(c, F.lit(default[f.name])) if f.name in default else c
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, store: str, table: str, buckets: int = BUCKETS) -> None:
    """Write a whole table; text blocks are laid out by page bucket."""
    rows = conform(df, table, buckets)
    if table == "text_blocks":  # one task per bucket, so that a bucket is one file
        (rows.repartition("page_bucket").write.mode("overwrite").partitionBy("page_bucket")
         .parquet(f"{store}/{table}"))
    else:
        rows.write.mode("overwrite").parquet(f"{store}/{table}")


def read_table(spark: SparkSession, store: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{store}/{table}")


def tenant_pages(pages: DataFrame, projects: DataFrame, user_id) -> DataFrame:
    """Pages of a user's own projects."""
    own = projects.where(F.col("user_id") == user_id).select(F.col("id").alias("project_id"))
    return pages.join(own, "project_id", "left_semi")


def tenant_scope(pages: DataFrame, projects: DataFrame) -> DataFrame:
    """Every page with the user who may see it, for jobs over all tenants."""
    return pages.join(projects.select(F.col("id").alias("project_id"), "user_id"), "project_id")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path, for the few files that are no tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _publish(spark: SparkSession, store: str, staging: str, touched: DataFrame) -> None:
    """Put the staged buckets in the place of the old ones; buckets left without rows go."""
    staged = spark.read.schema(SCHEMAS["text_blocks"]).parquet(staging)
    (staged.repartition("page_bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("page_bucket")
     .parquet(f"{store}/text_blocks"))
    empty = (touched.select(F.col("page_bucket").cast("bigint").alias("page_bucket")).distinct()
             .join(staged.select("page_bucket").distinct(), "page_bucket", "left_anti")
             .collect())  # at most ``buckets``
    for folder in [f"{store}/text_blocks/page_bucket={r[0]}" for r in empty]:
        files, path = _files(spark, folder)
        files.delete(path, True)


def replace_page_blocks(spark: SparkSession, store: str, blocks: DataFrame,
                        buckets: int = BUCKETS, pages: DataFrame | None = None,
                        user_id: int | None = None, batch: str | None = None) -> None:
    """Replace the blocks of all pages in ``blocks``; other pages are untouched.

    ``buckets`` is the number the store was written with. ``pages`` (page_id) also names pages
    that are to have no blocks any more. With ``user_id`` only pages of that user's own projects
    are replaced.

    Only the buckets that hold these pages are rewritten. The new version is written beside the
    store first, so a lost executor or a failed job leaves the old one in place until the
    final overwrite of exactly those buckets.

    A named ``batch`` is applied exactly once: its new version stays staged under its name until it
    is published and noted in the store. One that is noted changes nothing; one that was staged whole but
    broke off while it was published is published again from there, not worked out anew from a
    store that may be half new.
    """
    noted = f"{store}/_commits/{batch}"
    if batch is not None:
        files, path = _files(spark, noted)
        if files.exists(path):
            return
    if user_id is not None:
        own = tenant_pages(read_table(spark, store, "pages"),
                           read_table(spark, store, "projects"), user_id).select(
            F.col("id").alias("page_id"))
        blocks = blocks.join(own, "page_id", "left_semi")
        pages = None if pages is None else pages.join(own, "page_id", "left_semi")
    new = conform(blocks, "text_blocks", buckets)
    touched = new.select("page_id")
    if pages is not None:
        touched = touched.unionByName(pages.select(F.col("page_id").cast("bigint")))
    touched = touched.distinct().withColumn("page_bucket", F.pmod("page_id", F.lit(buckets)))
    staging = f"{store}/_staging/{batch or uuid.uuid4().hex}"
    files, whole = _files(spark, f"{staging}/_SUCCESS")
    if not files.exists(whole):
        old = read_table(spark, store, "text_blocks")
        kept = (old.join(touched.select("page_bucket").distinct(), "page_bucket", "left_semi")
                .join(touched.select("page_id"), "page_id", "left_anti").select(*new.columns))
        (kept.unionByName(new).repartition("page_bucket").write.mode("overwrite")
         .partitionBy("page_bucket").parquet(staging))
    _publish(spark, store, staging, touched)
    if batch is not None:
        files, path = _files(spark, noted)
        files.create(path, True).close()
    files, path = _files(spark, staging)
    files.delete(path, True)


def replace_from_stream(stream: DataFrame, store: str, checkpoint: str,
                        buckets: int = BUCKETS) -> None:
    """Replace the pages of every micro-batch that is there now, each exactly once.

    The blocks of a page come in one micro-batch; a later one replaces them. Batches are noted in
    the store under the name of the stream's checkpoint.
    """
    name = checkpoint.rstrip("/").rpartition("/")[2]

    def apply(blocks: DataFrame, batch_id: int) -> None:
        replace_page_blocks(blocks.sparkSession, store, blocks, buckets,
                            batch=f"{name}-{batch_id}")

    query = (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def migrate_confidence(old: DataFrame) -> DataFrame:
    """Text blocks with a DOUBLE confidence out of a table that stored whole numbers.

    Refuses a table that lacks columns; a table already migrated comes back as it is. Write
    the result to a new path.
    """
    from blockflow.operators.folds import schema_of
    need = [f.name for f in schema_of(SCHEMAS["text_blocks"]).fields if f.name != "page_bucket"]
    missing = [c for c in need if c not in old.columns]
    if missing:
        raise ValueError("columns missing: " + ", ".join(missing))
    return old.withColumn("confidence", F.col("confidence").cast("double"))


def delete_project(projects: DataFrame, pages: DataFrame, blocks: DataFrame, project_id,
                   user_id) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a project of this user; another user's project stays.

    What goes is a single project, so its id is broadcast and the tables are not sorted for it.
    """
    gone = F.broadcast(projects.where((F.col("id") == project_id) & (F.col("user_id") == user_id))
                       .select("id").distinct())
    gone_pages = pages.join(gone.select(F.col("id").alias("project_id")), "project_id",
                            "left_semi").select("id")
    return (projects.join(gone, "id", "left_anti"),
            pages.join(gone.select(F.col("id").alias("project_id")), "project_id", "left_anti"),
            blocks.join(gone_pages.select(F.col("id").alias("page_id")), "page_id", "left_anti"))
