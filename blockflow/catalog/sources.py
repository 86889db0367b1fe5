"""Sources and sinks: written from the given tables, read back, and compared."""

import uuid

from pyspark.sql import functions as F

from blockflow.fixtures import cte
from blockflow.functions import text as tx
from blockflow.session import shared_dir
from blockflow.sources import checkpoints as cp
from blockflow.sources import documents as do
from blockflow.sources import labels as lb
from blockflow.sources import store as st


def folder(fx, name):
    return f"{shared_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


def run_pages(fx):
    """One page per conversation, in runs named after the last digit of its number."""
    return fx.conversations.groupBy(F.col("conv_id").alias("page")).agg(
        F.count("*").alias("n_blocks"), F.max("turn").alias("n_translated")).withColumn(
        "run", F.concat(F.lit("run"), F.col("page") % 4)).withColumn(
        "status", F.lit("OK")).withColumn("elapsed_s", F.col("page") / 4.0)


def round_trip(fx):
    path = folder(fx, "checkpoints")
    pairs = fx.pairs.select(
        F.concat(F.lit("run"), F.col("doc_id") % 4).alias("run"), F.col("doc_id").alias("page"),
        F.col("seq").alias("pos"), "src", "tgt", "block_type", "source_lang", "target_lang")
    cp.write_checkpoints(run_pages(fx), pairs, path)
    return cp.read_checkpoints(fx.spark, path)


def label_lines(fx):
    """Gold boxes as label lines, some of them broken in every way."""
    k = F.col("gold_id") % 23
    good = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("cls").cast("int"),
                           (F.col("x") + F.col("w") / 2) / F.lit(2000.0), F.lit(0.5),
                           F.col("w") / F.lit(2000.0), F.lit(0.25))
    return tx.once(fx.gold, line=F.when(k == 1, "# note").when(k == 2, "0 0.5 0.5")
                   .when(k == 3, "0 a 0.5 0.1 0.1").when(k == 4, "7 0.5 0.5 0.1 0.1")
                   .when(k == 5, "1 1.5 0.5 0.1 0.1").when(k == 6, "").otherwise(good)
                   ).select("page_id", "gold_id", "line")


def unit_boxes(fx):
    return fx.gold.join(fx.page_sizes, "page_id").select(
        "page_id", "gold_id", "cls", ((F.col("x") + F.col("w") / 2) / F.col("page_w")).alias("cx"),
        ((F.col("y") + F.col("h") / 2) / F.col("page_h")).alias("cy"),
        (F.col("w") / F.col("page_w")).alias("w"), (F.col("h") / F.col("page_h")).alias("h"))


def written_labels(fx):
    path = folder(fx, "labels")
    boxes = fx.documents.select(
        F.col("source").alias("page_id"), (F.col("doc_id") % 2).alias("cls"),
        ((F.col("doc_id") % 100) / 100.0).alias("cx"), F.lit(0.5).alias("cy"),
        F.lit(0.25).alias("w"), ((F.col("n_chars") % 50) / 100.0).alias("h"))
    pages = fx.documents.select(F.col("source").alias("page_id")).distinct().withColumn(
        "split", F.when(F.col("page_id").endswith("3"), "val").otherwise("train"))
    lb.write_labels(boxes, pages, path)
    lines = fx.spark.read.text(path + "/labels").select(
        "page_id", "split", F.col("value").alias("line"))
    return lb.parse_labels(lines)[0]


def label_files(fx):
    """Labels of every page written as files and read as any label files are."""
    path = folder(fx, "label-files")
    boxes = fx.documents.select(
        F.col("source").alias("page_id"), (F.col("doc_id") % 2).alias("cls"),
        ((F.col("doc_id") % 100) / 100.0).alias("cx"), F.lit(0.5).alias("cy"),
        F.lit(0.25).alias("w"), ((F.col("n_chars") % 50) / 100.0).alias("h"))
    lb.write_labels(boxes, boxes.select("page_id").distinct().withColumn("split", F.lit("train")),
                    path)
    boxes, rejects = lb.read_labels(fx.spark, path + "/labels")
    return boxes.drop("path"), rejects


def streams(fx):
    """Documents as model output: a section per line, an image tag after every third."""
    tag = F.concat(F.lit("<PAGE>\n<|det|>text [1, 2, 3, 4]<|/det|> "), F.col("text"),
                   F.when(F.col("i") % 3 == 0, "\n<|det|>image [5, 6, 7, 8]<|/det|>").otherwise(""))
    lines = fx.lines.groupBy(F.col("doc_id").alias("stream_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", tag.alias("t")))),
                                 lambda r: r["t"]), "\n").alias("stream"),
        (F.count("*") + 1).alias("n_images"))
    return lines


def written_logs(fx):
    path = folder(fx, "logs")
    fx.log_lines.select("file", "event_id", "line").repartition("file").sortWithinPartitions(
        "file", "event_id").select("file", "line").write.partitionBy("file").text(path)
    return do.read_logs(fx.spark, path).select(
        F.regexp_extract("path", "file=([^/]+)/", 1).alias("file"), "line_no", "line")


def benchmark_pages(fx):
    """Benchmark records, some hundred pages to a document."""
    path = folder(fx, "bench")
    rec = F.struct(F.col("value").alias("total_s"), (F.col("event_id") % 9).alias("n_blocks"),
                   F.create_map(F.lit("detect"), F.col("value") / 2).alias("stages"),
                   F.create_map(F.lit("yolo"), F.col("event_id") % 3).alias("calls"))
    docs = fx.events.groupBy(F.floor(F.col("event_id") / 100).alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), rec)))
        .alias("per_page"))
    docs.select(F.to_json(F.struct("per_page")).alias("value")).write.text(path)
    return do.read_page_benchmarks(fx.spark, path)


def diagnostics(fx):
    path = folder(fx, "diag")
    doc = fx.events.select(F.to_json(F.struct(
        (F.col("event_id") % 2 + 1).alias("schema_version"), F.col("event_id").cast("string")
        .alias("doc_id"), F.create_map(F.lit("ocr"), F.col("value"), F.lit("merge"), F.lit(0.5))
        .alias("timings"), F.when(F.col("event_type") == "error", F.array(F.lit("timeout")))
        .otherwise(F.array().cast("array<string>")).alias("errors"))).alias("value"))
    doc.write.text(path)
    return do.read_page_diagnostics(fx.spark, path, 1)


def shop(fx):
    """Customers, orders and order lines as projects, pages and text blocks."""
    projects = fx.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey")
                                .alias("user_id"))
    pages = fx.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                               F.col("l_orderkey").alias("project_id"),
                               F.col("l_linenumber").alias("page_number"))
    blocks = pages.select(F.col("id"), F.col("id").alias("page_id"))
    return projects, pages, blocks


def replaced(fx):
    """Blocks of every document stored, those of even documents replaced by another engine's,
    those of every tenth by nothing."""
    store = folder(fx, "store")

    def rows(engine):
        return fx.blocks.where(F.col("engine") == engine).select(
            F.col("block_id").alias("id"), "page_id", "x", "y", "w", "h",
            F.col("text").alias("source_text"), "confidence")

    st.write_table(rows(0), store, "text_blocks", 16)
    st.replace_page_blocks(fx.spark, store, rows(1).where("page_id % 2 = 0 and page_id % 10 <> 0"),
                           16, fx.documents.select(F.col("doc_id").alias("page_id"))
                           .where("page_id % 2 = 0"))
    return st.read_table(fx.spark, store, "text_blocks")


PART_ROWS = 400_000  # rows of a part that is counted by one task


def after_delete(fx, user):
    """Rows per project in the three tables once a user has deleted project 7.

    Nearly every order is a group of its own, so rows are dealt by project into parts of a bounded
    number of rows before they are counted: neither side of the count holds more groups than that.
    """
    projects, pages, blocks = st.delete_project(*shop(fx), 7, user)
    parts = 1 + fx.lineitem.count() // PART_ROWS
    of = [("projects", projects.select(F.col("id").alias("project_id"))),
          ("pages", pages.select("project_id")),
          ("blocks", blocks.select(F.floor(F.col("page_id") / 10).alias("project_id")))]
    counted = [df.repartition(parts, "project_id").groupBy("project_id").agg(
        F.count("*").alias("n")).withColumn("kind", F.lit(kind)) for kind, df in of]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def url_files(fx):
    """Page addresses as paths: host / language / file."""
    return fx.pages.select(F.concat(F.lit("/lib/"), F.regexp_extract(
        "url", r"//([^/]+)/", 1), F.lit("/"), F.regexp_extract("url", r"//[^/]+/([^/?#]+)/", 1),
        F.lit("/"), F.regexp_extract("url", r"/(\d+)[^/]*$", 1), F.lit("_"), F.col("page_id"), F.lit(".png"))
        .alias("path"))


FILES = r"""with f as (select page_id, regexp_extract(url, '//([^/]+)/', 1) || '/' || regexp_extract(url, '//[^/]+/([^/?#]+)/', 1) as document,
    regexp_extract(url, '//([^/]+)/', 1) as host, regexp_extract(url, '//[^/]+/([^/?#]+)/', 1) as leaf,
    regexp_extract(url, '/(\d+)[^/]*$', 1) as num from pages)
"""
DELETED = """with a as (select o_orderkey as p, 'projects' as kind from orders union all
    select l_orderkey, k from lineitem, (values ('pages'), ('blocks')) v(k))
  select p as project_id, kind, count(*) as n from a {} group by 1, 2"""
LABEL_LINES = cte("gold") + """, j as (select page_id, gold_id, cls, x, w, gold_id % 23 as k from gold)
"""

QUERIES = {
    "read_checkpoints": lambda fx: round_trip(fx)[1].select(
        "run", "page", "pos", "src", "tgt", "source_lang", "target_lang", "block_type",
        "has_metadata"),
    "write_checkpoints": lambda fx: round_trip(fx)[0],
    "document_catalog": lambda fx: do.document_catalog(url_files(fx), "/lib")[1].select(
        "document", "page", F.regexp_extract("path", r"_(\d+)\.png", 1).cast("bigint")
        .alias("page_id")),
    "document_names": lambda fx: do.document_catalog(url_files(fx), "/lib")[0],
    "read_labels": lambda fx: lb.parse_labels(label_lines(fx))[0],
    "read_labels_rejects": lambda fx: lb.parse_labels(label_lines(fx))[1].groupBy("reason").agg(
        F.count("*").alias("n")),
    "write_labels": written_labels,
    "label_line": lambda fx: lb.label_line(unit_boxes(fx)).select("page_id", "gold_id", "line"),
    "to_pixels": lambda fx: lb.to_pixels(unit_boxes(fx), fx.page_sizes).select(
        "page_id", "gold_id", F.round("x").cast("bigint").alias("x"), F.round("y").cast("bigint")
        .alias("y"), F.round("w").cast("bigint").alias("w"), F.round("h").cast("bigint")
        .alias("h")),
    "merge_corrections": lambda fx: lb.merge_corrections(
        fx.gold.drop("gold_id"), fx.dets.drop("det_id", "confidence").where("page_id % 7 <> 0"),
        fx.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id")),
        fx.documents.where("doc_id % 6 <> 0").select(F.col("doc_id").alias("page_id"), F.when(
            F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"))).groupBy(
        "page_id", "split").agg(F.count("*").alias("n"), F.sum("x").alias("x")),
    "correction_summary": lambda fx: lb.correction_summary(
        fx.gold, fx.dets.where("page_id % 7 <> 0"),
        fx.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id")),
        fx.documents.where("doc_id % 6 <> 0").select(F.col("doc_id").alias("page_id"))),
    "read_detection_markup": lambda fx: do.read_detection_markup(streams(fx))[0],
    "read_detection_markup_pages": lambda fx: do.read_detection_markup(streams(fx))[1],
    "rescale_boxes": lambda fx: do.rescale_boxes(
        fx.blocks.select("page_id", "block_id", *[(F.col(c) * 3 % 640).alias(c) for c in "xywh"]),
        640.0, fx.page_sizes),
    "read_logs": written_logs,
    "read_page_benchmarks": lambda fx: do.long_form(benchmark_pages(fx)),
    "read_page_diagnostics": lambda fx: diagnostics(fx)[1],
    "export_pages": lambda fx: do.export_blocks(fx.blocks.withColumn("source", F.when(
        F.col("engine") == 0, "yolo").when(F.col("engine") == 1, "vlm"))).select(
        "page_id", "block_id", "texto", F.array_join("bbox", ",").alias("bbox"), "conf",
        F.array_join("motores", ",").alias("motores"), "detector"),
    "label_round_trip": lambda fx: label_files(fx)[0],
    "page_store": lambda fx: st.conform(fx.blocks.select(
        F.col("block_id").alias("id"), "page_id", "x", "y", "w", "h", F.col("text").alias(
            "source_text"), F.when(F.col("engine") == 0, F.col("confidence")).alias(
            "confidence")), "text_blocks").select("page_id", "id", "confidence", "font_size",
                                                  "bg_color", "page_bucket"),
    "replace_page_blocks": lambda fx: replaced(fx).select("page_id", "id", "source_text",
                                                          "confidence"),
    "migrate_confidence": lambda fx: st.migrate_confidence(st.conform(fx.blocks.select(
        F.col("block_id").alias("id"), "page_id", "x", "y", "w", "h", "confidence"),
        "text_blocks").withColumn("confidence", (F.col("confidence") * 100).cast("int"))).select(
        "page_id", "id", "confidence"),
    "tenant_scope": lambda fx: st.tenant_scope(shop(fx)[1], shop(fx)[0]).groupBy("user_id").agg(
        F.count("*").alias("pages")),
    "tenant_pages": lambda fx: st.tenant_pages(shop(fx)[1], shop(fx)[0], 7),
    "delete_project": lambda fx: after_delete(fx, fx.orders.where("o_orderkey = 7").agg(
        F.max("o_custkey")).first()[0]),
    "delete_foreign_project": lambda fx: after_delete(fx, -1),
}


ORACLES = {
    "read_checkpoints": cte("pairs") + "select 'run' || (doc_id % 4) as run, doc_id as page, row_number() over (partition by doc_id order by seq) - 1 as pos, src, tgt, source_lang, target_lang, block_type, true as has_metadata from pairs",
    "write_checkpoints": "select conv_id as page, 'run' || (conv_id % 4) as run, 'OK' as status, count(*) as n_blocks, max(turn) as n_translated, conv_id / 4 as elapsed_s from conversations group by conv_id",
    "document_catalog": FILES + "select document, row_number() over (partition by document order by num = '', cast(nullif(num, '') as bigint), page_id) as page, page_id from f",
    "document_names": FILES + """, d as (select document, host, leaf, count(*) as n_pages from f group by 1, 2, 3), r as (select *, row_number() over (partition by leaf order by document) as k from d)
      select document, 'carpeta' as kind, case when k = 1 then leaf else host || '_' || leaf end as name, n_pages from r""",
    "read_labels": LABEL_LINES + "select page_id, gold_id, cast(cls as int) as cls, round((x + w / 2) / 2000, 6) as cx, 0.5 as cy, round(w / 2000, 6) as w, 0.25 as h from j where k not between 1 and 6",
    "read_labels_rejects": LABEL_LINES + "select case k when 2 then 'arity' when 3 then 'not_numeric' when 4 then 'class' else 'range' end as reason, count(*) as n from j where k between 2 and 5 group by 1",
    "write_labels": "select source as page_id, case when ends_with(source, '3') then 'val' else 'train' end as split, cast(doc_id % 2 as int) as cls, (doc_id % 100) / 100 as cx, 0.5 as cy, 0.25 as w, (n_chars % 50) / 100 as h from documents",
    "label_line": cte("gold", "page_sizes") + "select page_id, gold_id, format('{:d} {:.6f} {:.6f} {:.6f} {:.6f}', cls, (x + w / 2) / page_w, (y + h / 2) / page_h, w / page_w, h / page_h) as line from gold join page_sizes using (page_id)",
    "to_pixels": cte("gold") + "select page_id, gold_id, x, y, w, h from gold",
    "merge_corrections": cte("gold", "dets") + """, m as (select page_id, x from gold where page_id % 3 <> 0 union all select page_id, x from dets where page_id % 7 <> 0 and page_id % 3 = 0)
      select page_id, case when page_id % 6 <> 0 and page_id % 5 = 0 then 'val' else 'train' end as split, count(*) as n, sum(x)::bigint as x from m group by 1""",
    "correction_summary": cte("gold", "dets") + """, t as (select doc_id as page_id, doc_id % 6 <> 0 as known from documents where doc_id % 3 = 0), b as (select page_id, count(*) as n from gold group by 1), a as (select page_id, count(*) as n from dets where page_id % 7 <> 0 group by 1)
      select count(*) filter (known) as corrected, count(*) filter (not known) as new, count(*) filter (known and coalesce(a.n, 0) = 0) as emptied, sum(case when known then coalesce(b.n, 0) else 0 end)::bigint as labels_before, sum(coalesce(a.n, 0))::bigint as labels_after from t left join b using (page_id) left join a using (page_id)""",
    "read_detection_markup": cte("lines") + r""", s as (select *, row_number() over (partition by doc_id order by i) - 1 as k from lines)
      select doc_id as stream_id, cast(k as int) as page_no, 0 as pos, 'text' as type, 1::bigint as x, 2::bigint as y, 3::bigint as w, 4::bigint as h, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from s
      union all select doc_id, cast(k as int), 1, 'image', 5, 6, 7, 8, '' from s where i % 3 = 0""",
    "read_detection_markup_pages": cte("lines") + """, n as (select doc_id, count(*) + 1 as n from lines group by 1), p as (select doc_id, n, unnest(range(n)) as k from n),
      s as (select doc_id, i, row_number() over (partition by doc_id order by i) - 1 as k from lines)
      select p.doc_id as stream_id, cast(p.k as int) as page_no, case when s.i is null then 0 when s.i % 3 = 0 then 2 else 1 end::bigint as n_blocks from p left join s on s.doc_id = p.doc_id and s.k = p.k""",
    "rescale_boxes": cte("page_sizes") + """select page_id, block_id, cast(round_even(x * 3 % 640 / 640 * page_w, 0) as bigint) as x, cast(round_even(y * 3 % 640 / 640 * page_h, 0) as bigint) as y,
      greatest(1, cast(round_even(w * 3 % 640 / 640 * page_w, 0) as bigint)) as w, greatest(1, cast(round_even(h * 3 % 640 / 640 * page_h, 0) as bigint)) as h from blocks join page_sizes using (page_id)""",
    "read_page_benchmarks": "select event_id as page, 'stage' as kind, 'detect' as name, value / 2 as value from events union all select event_id, 'call', 'yolo', event_id % 3 from events",
    "read_page_diagnostics": "select cast(event_id as varchar) as doc_id, 'ocr' as stage, value as seconds from events where event_id % 2 = 0 union all select cast(event_id as varchar), 'merge', 0.5 from events where event_id % 2 = 0",
    "export_pages": cte("blocks") + """select page_id, block_id, text as texto, x || ',' || y || ',' || (x + w) || ',' || (y + h) as bbox, round(confidence, 3) as conf,
      case engine when 0 then 'easyocr,rapid,yolo' when 1 then 'easyocr,rapid,vlm' else 'easyocr,rapid' end as motores, case engine when 0 then 'yolo' when 1 then 'vlm' else 'hibrido' end as detector from blocks""",
    "page_store": cte("blocks") + "select page_id, block_id as id, case when engine = 0 then confidence else 0 end as confidence, 12::bigint as font_size, '#000000' as bg_color, page_id % 256 as page_bucket from blocks",
    "replace_page_blocks": cte("blocks") + "select page_id, block_id as id, text as source_text, confidence from blocks where engine = case when page_id % 2 = 0 then 1 else 0 end and page_id % 10 <> 0",
    "migrate_confidence": cte("blocks") + "select page_id, block_id as id, trunc(confidence * 100) as confidence from blocks",
    "tenant_scope": "select o_custkey as user_id, count(*) as pages from lineitem join orders on o_orderkey = l_orderkey group by 1",
    "tenant_pages": "select l_orderkey * 10 + l_linenumber as id, l_orderkey as project_id, l_linenumber as page_number from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey = 7)",
    "delete_project": DELETED.format("where p <> 7"),
    "delete_foreign_project": DELETED.format(""),
    "read_logs": cte("log_lines") + "select file, line, row_number() over (partition by file order by event_id) as line_no from log_lines",
    "label_round_trip": "select source as page, cast(doc_id % 2 as int) as cls, (doc_id % 100) / 100 as cx, 0.5 as cy, 0.25 as w, (n_chars % 50) / 100 as h from documents",
}
