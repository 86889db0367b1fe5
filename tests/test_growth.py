"""Work that must not grow beyond its share: sizes of tasks, ties, whole results."""

import random

from pyspark.sql import functions as F

from blockflow.catalog import boxes, sources
from blockflow.fixtures import Fixtures
from blockflow.functions import text as tx
from blockflow.operators import blocks as bl
from blockflow.operators import joins as jo
from blockflow.operators import language as la
from blockflow.operators import memory as me
from blockflow.operators import quality as qu
from blockflow.operators import score as sc
from blockflow.operators import spelling as sp
from blockflow.operators import texts as te
from blockflow.rules import languages as lg
from blockflow.session import checkpointed
from blockflow.sources import labels as lb

TINY = "/root/testdata/sf0.001"


def test_deleted_projects_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(sources, "PART_ROWS", 500)
    fx = Fixtures(spark, TINY)
    counted = sources.after_delete(fx, -1)
    assert counted.rdd.getNumPartitions() >= fx.lineitem.count() // 500
    assert counted.agg(F.sum("n")).first()[0] == fx.orders.count() + 2 * fx.lineitem.count()


def test_strings_left_by_deletions_are_never_broadcast(spark):
    words = spark.createDataFrame([("hausen",), ("gartem",)], "word string")
    known = spark.createDataFrame([("hause", 3), ("garten", 5)], "word string, freq bigint")
    found = sp.dictionary_candidates(checkpointed(words), checkpointed(known), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert {(r.word, r.candidate, r.dist) for r in found.collect()} == {
        ("hausen", "hause", 1), ("gartem", "garten", 1)}


def test_first_of_equally_new_cache_entries_answers(spark):
    cache = spark.createDataFrame(
        [("hola", "es", "en", r, 5.0, i) for i, r in ((3, "hey"), (1, "hi"), (2, "hello"))]
        + [("hola", "es", "en", "old", 4.0, 0)],
        "text string, src string, tgt string, result string, ts double, id int").repartition(4)
    asked = spark.createDataFrame([(" hola", "ES ", "en")],
                                  "text string, source_lang string, target_lang string")
    assert me.cache_lookup(asked, cache, 5.0, order=("id",)).first().cache_result == "hi"


def test_a_request_without_text_meets_no_cache_entry(spark):
    cache = spark.createDataFrame([(None, "es", "en", "hi", 5.0), ("", "es", "en", "none", 5.0)],
                                  "text string, src string, tgt string, result string, ts double")
    asked = spark.createDataFrame([(1, None, "es", "en"), (2, " ", "es", "en")],
                                  "id int, text string, source_lang string, target_lang string")
    got = {r.id: r.cache_result for r in me.cache_lookup(asked, cache, 5.0).collect()}
    assert got == {1: None, 2: "none"}


def test_every_way_of_translating_is_shown(spark):
    rows = [("田中さん", f"Tanaka {i:02d}", "ja", "es", None) for i in range(30)]
    df = spark.createDataFrame(rows, "src string, tgt string, source_lang string, "
                                     "target_lang string, block_type string")
    got = qu.consistency_conflicts(df).first()
    assert got.n_targets == 30 and list(got.targets) == [r[1] for r in rows]


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_expensive_columns_are_worked_out_once(spark):
    lines = checkpointed(spark.createDataFrame([("0 0.5 0.5 0.1 0.1",)], "line string"))
    boxes, rejects = lb.parse_labels(lines)
    assert optimised(boxes).count("split(") == optimised(rejects).count("split(") == 1
    blocks = checkpointed(spark.createDataFrame(
        [(1, 2, "uno dos", "text", False, 12, 0.5, 10, 10)],
        "page_id int, source int, text string, type string, from_art_recrop boolean, "
        "font_size int, confidence double, w int, h int"))
    assert "Generate inline" in optimised(bl.estimate_confidence(blocks))
    assert "Generate inline" in optimised(bl.drop_junk_blocks(blocks)[1])
    assert "size(filter(" not in optimised(sc.word_recall(blocks, blocks))
    assert "size(filter(" not in optimised(sp.tokens_of(blocks, ["page_id"]))


def test_rules_apply_as_one_by_one_and_unchanged_texts_skip_them(spark):
    rules = [(r"\bR\b", "Y"), (r"@", ""), (r"\bY S(\d+)\b", "ys $1")]
    texts = ["R", "a@b", "nothing here", "r s12", "RR", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [r.out for r in te.apply_glossary(df, rules, out="out").collect()]
    assert got == ["Y", "ab", "nothing here", "ys 12", "RR", "", None]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_of_a_page_are_shuffled_once(spark):
    assert shuffles(boxes.QUERIES["word_recall"](Fixtures(spark, TINY))) <= 2
    ref = spark.createDataFrame([(1, "uno dos"), (1, "dos tres"), (2, " "), (3, "solo")],
                                "page_id int, text string")
    hyp = spark.createDataFrame([(1, "a", "dos DOS cinco"), (1, "a", "uno"), (1, "b", ""),
                                 (1, "c", None), (2, "a", "uno"), (4, "a", "solo")],
                                "page_id int, source string, text string")
    got = {(r.page_id, r.source, r.ref_words, r.found) for r in sc.word_recall(ref, hyp).collect()}
    assert got == {(1, "a", 3, 2), (1, "b", 3, 0), (1, "c", 3, 0)}
    assert sc.word_recall(ref, hyp.limit(0)).isEmpty()
    many = hyp.select("page_id", F.explode(F.sequence(F.lit(1), F.lit(130))).alias("source"), "text")
    assert {(r.source, r.found) for r in sc.word_recall(ref, many).collect()} == {
        (k, 2) for k in range(1, 131)}


def test_the_language_of_texts_to_correct_is_told_once(spark):
    texts = spark.createDataFrame([(1, "la caza, caas Caas"), (2, None), (3, ""), (4, "el gato"),
                                   (5, "caas")], "id int, text string")
    known = spark.createDataFrame([("caza", 9), ("casa", 5), ("gato", 5)], "word string, freq bigint")
    got = sp.correct_spelling(texts, known, ["id"])
    assert lg.SPANISH_MARKS not in optimised(got)
    assert {r.id: r.corrected for r in got.collect()} == {
        1: "la caza, casa Casa", 2: None, 3: "", 4: "el gato", 5: "caas"}


def test_texts_to_fuse_are_shuffled_once_and_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(bl, "checkpointed", lambda df: written.append(df.columns) or checkpointed(df))
    rows = [(1, k, k % 2, 10 * (k % 3), 7 * k, 40, 4 + 30 * (k % 4), f"uno {k // 2}", 0.5, "text")
            for k in range(40)]
    rows += [(2, 1, 0, 0, 0, 5, 5, "solo", None, "TEXT"), (None, 2, 0, 0, 0, 5, 5, "x", 0.5, "text"),
             (1, 90, 1, 0, 0, 5, 5, "  ", 0.5, "text")]
    df = spark.createDataFrame(rows, "page_id bigint, block_id bigint, engine int, x bigint, y bigint, "
                                     "w bigint, h bigint, text string, confidence double, type string")
    whole = bl.fuse_sources(df, {0: 1.0, 1: 0.9}, tile=10_000)
    assert shuffles(whole) == 1 and not any("text" in columns for columns in written)
    want = sorted(whole.collect())
    assert (2, 1, 0, 0, 0, 5, 5, "solo", 0.5, "text") in want and len(want) < 42
    for tile in (16, 64):
        assert sorted(bl.fuse_sources(df, {0: 1.0, 1: 0.9}, tile=tile).collect()) == want
    assert sorted(bl.fuse_sources(df, {0: 1.0, 1: 0.9}, tile=64, most=3).collect()) == want


def test_boxes_of_labels_are_written_once(spark, monkeypatch):
    written = []
    for module in (bl, jo):
        monkeypatch.setattr(module, "checkpointed",
                            lambda df: written.append(df.columns) or checkpointed(df))
    rows = [(p, k, 13 * k % 80, 17 * k % 210, 15 + 5 * (k % 4), 12 + 9 * (k % 5), kind)
            for p in (1, 2, 3) for k, kind in enumerate(["text", "title", None, "header"] * 8)]
    rows += [(1, 50, 0, 0, 40, 40, "title"), (1, 49, 0, 0, 40, 40, "text"), (2, 60, 5, 5, 9, 90, "text"),
             (4, 1, 0, 0, 20, 20, "text"), (None, 1, 0, 0, 20, 20, "text")]
    blocks = spark.createDataFrame(rows, "page_id bigint, block_id bigint, x bigint, y bigint, w int, "
                                         "h bigint, type string")
    regions = blocks.where("block_id % 3 = 1 and page_id < 3").select(
        "page_id", F.col("block_id").alias("region_id"), (F.col("x") + 2).alias("x"), "y", "w", "h",
        F.when(F.col("block_id") % 2 == 0, "text_free").otherwise("text_bubble").alias("label"))
    pages = spark.createDataFrame([(p, 120, 260) for p in (1, 2, 3)],
                                  "page_id bigint, page_w bigint, page_h bigint")
    found = bl.clean_labels(blocks, regions, pages)
    assert sum("w" in columns for columns in written) == 1
    want = sorted(found.collect())
    assert {r.page_id for r in want} == {1, 2, 3} and {r.cls for r in want} == {0, 1}
    for how in ({"tile": 32}, {"most": 0}, {"most": 20, "tile": 64}):
        other = bl.clean_labels(blocks, regions, pages, **how)
        assert other.dtypes == found.dtypes and sorted(other.collect()) == want


def test_shorter_tests_of_words_and_languages_say_the_same(spark):
    pick, parts = random.Random(4), ["a", "e", "Z", "Ñ", "ǅ", "𝐀", "ß", "7", "٣", "'", "¡", ".", "-", "(", " ",
                                     "\n", "\u00a0", "\u0085", "dar", "mente", "la", "você", "é", "田", "한", "の", ""]
    texts = ["".join(pick.choices(parts, k=pick.randrange(9))) for _ in range(3000)] + ["the house", ""]
    df = checkpointed(spark.createDataFrame([(t,) for t in texts], "text string"))
    told = la.simple_language(F.col("text"), la.word_set(F.col("text")))
    for lang in ("es", "en"):
        assert df.where((told == lang) != la.is_simple_language(F.col("text"), lang)).isEmpty()
    bare = F.col("bare")
    words = tx.once(df.select(F.explode(tx.words(F.col("text"))).alias("token")), bare=F.btrim(
        "token", F.lit(sp.EDGES)))
    usable = ~bare.rlike(r"\p{Nd}") & ~(bare.rlike(r"\p{Lu}") & ~bare.rlike(r"\p{Ll}"))
    assert words.where((bare != tx.strip_chars(F.col("token"), sp.EDGES))
                       | (usable != bare.rlike(sp.USABLE))).isEmpty()
    assert {r[0] for r in words.select(usable).distinct().collect()} == {True, False}
