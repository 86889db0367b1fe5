"""Stream and batch forms agree on ordered input; restarts process only what is new."""

import pytest
from pyspark.sql import functions as F

from blockflow.fixtures import Fixtures
from blockflow.catalog import streams as cs
from blockflow.operators import memory as me
from blockflow.sources import store as st
from blockflow.streaming import jobs, state

SF = "/root/testdata/sf0.001"


def same(a, b, columns):
    return (sorted(map(str, a.select(*columns).collect()))
            == sorted(map(str, b.select(*columns).collect())))


def test_memory(spark):
    fx = Fixtures(spark, SF)
    stream = cs.done(fx, state.learn_stream(cs.stream_of(fx, "memory_events")))
    last = stream.groupBy(*me.KEYS).agg(F.max_by(F.struct(
        "translation", "quality", "occurrences"), "event_id").alias("e")).select(*me.KEYS, "e.*")
    assert same(last, me.learn_memory(fx.memory_events),
                [*me.KEYS, "translation", "quality", "occurrences"])


EVENTS = "doc_id bigint, source string, translation string, source_lang string, " \
         "target_lang string, quality double, event_id bigint, t double"


def test_an_expired_key_leaves_the_state(spark, tmp_path):
    """The state store itself: keys not used for the time limit are gone without coming again."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = 86_400.0

    def feed(*rows):
        spark.createDataFrame([(1, s, f"{s} {n}", "ja", "es", q, n, 1.7e9 + d * day)
                               for n, s, q, d in rows], EVENTS).withColumn(
            "ts", F.timestamp_seconds("t")).write.mode("append").parquet(source)

    def run():
        schema = spark.read.parquet(source).schema
        stream = state.learn_stream(spark.readStream.schema(schema).parquet(source),
                                    ttl_s=30 * day)
        rows = jobs.run_to_table(stream, out).collect()
        stored = (spark.read.format("statestore").option("path", out + "/checkpoint")
                  .option("stateVarName", "held").load().collect())
        return {r.event_id: (r.translation, r.occurrences) for r in rows}, stored

    feed((1, "\u7530\u4e2d", 0.9, 0), (2, "\u9ed2\u5d0e", 0.9, 0))
    first, stored = run()
    assert first == {1: ("\u7530\u4e2d 1", 1), 2: ("\u9ed2\u5d0e 2", 1)} and len(stored) == 2
    feed((3, "\u9ed2\u5d0e", 0.9, 10), (4, "\u5c71\u5ddd", 0.9, 20))
    assert len(run()[1]) == 3
    feed((5, "\u5c71\u5ddd", 0.9, 35))  # the watermark is beyond day 30 after this
    run()
    feed((6, "\u5c71\u5ddd", 0.9, 36))
    later, stored = run()
    assert later[3] == ("\u9ed2\u5d0e 2", 2)
    assert len(stored) == 2  # the first key is gone, though it never came again
    feed((7, "\u7530\u4e2d", 0.7, 36))
    assert run()[0][7] == ("\u7530\u4e2d 7", 1)


def test_a_second_run_adds_only_new_input(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(source)
    stream = spark.readStream.schema("id bigint").parquet(source)
    assert jobs.run_to_table(stream, out).count() == 10
    spark.range(10, 15).write.mode("append").parquet(source)
    assert jobs.run_to_table(spark.readStream.schema("id bigint").parquet(source),
                             out).count() == 15


def _blocks(spark, text, pages):
    return spark.createDataFrame([(100 * p + i, p, 0, 10 * i, 5, 5, f"{text} {p} {i}")
                                  for p in pages for i in range(3)],
                                 "id bigint, page_id bigint, x bigint, y bigint, w bigint,"
                                 " h bigint, source_text string")


def _stored(spark, store):
    return sorted(r.source_text for r in st.read_table(spark, store, "text_blocks").collect())


def _texts(*parts):
    return sorted(f"{text} {p} {i}" for text, pages in parts for p in pages for i in range(3))


def test_pages_are_replaced_from_a_stream_exactly_once(spark, tmp_path, monkeypatch):
    store, source = str(tmp_path / "store"), str(tmp_path / "in")
    st.write_table(_blocks(spark, "old", range(8)), store, "text_blocks", 4)
    first = _blocks(spark, "new", [1, 2])
    first.write.parquet(source)

    def run():
        st.replace_from_stream(spark.readStream.schema(first.schema).parquet(source), store,
                               str(tmp_path / "pages"), 4)

    run()
    rest = [0, 3, 4, 5, 6, 7]
    assert _stored(spark, store) == _texts(("old", rest), ("new", [1, 2]))
    # Somebody else changes a page; the batch comes again under its number and changes nothing.
    st.replace_page_blocks(spark, store, _blocks(spark, "other", [1]), 4)
    st.replace_page_blocks(spark, store, first, 4, batch="pages-0")
    assert _stored(spark, store) == _texts(("old", rest), ("new", [2]), ("other", [1]))

    # A batch breaks off while it is published, after a bucket of the store is gone already.
    def broken(spark, store, staging, touched):
        files, path = st._files(spark, f"{store}/text_blocks/page_bucket=3")
        files.delete(path, True)
        raise RuntimeError("lost")

    _blocks(spark, "late", [3]).write.mode("append").parquet(source)
    whole = st._publish
    monkeypatch.setattr(st, "_publish", broken)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(st, "_publish", whole)
    run()
    assert _stored(spark, store) == _texts(("old", [0, 4, 5, 6, 7]), ("new", [2]),
                                           ("other", [1]), ("late", [3]))
