"""Order-dependent jobs against plain models on small random inputs, and their invariants."""

import random

import pytest
from pyspark.sql import functions as F

from blockflow.functions import boxes as bx
from blockflow.operators import blocks as bl
from blockflow.operators import cells
from blockflow.operators import joins as jn
from blockflow.operators import memory as me
from blockflow.operators import rounds, scan
from blockflow.operators import score as sc
from blockflow.operators import sequences as sq
from blockflow.session import checkpointed

BASE = 1_700_000_000.0


def random_boxes(seed, pages=3, n=40, height=900):
    r = random.Random(seed)
    return [dict(page_id=p, det_id=i, block_id=i, cls=r.randrange(2), x=r.randrange(300),
                 y=r.randrange(height), w=r.randrange(20, 120), h=r.randrange(10, 80),
                 confidence=r.randrange(5, 100) / 100, engine=r.randrange(3),
                 text=r.choice(["hola mundo", "hola mundc", "otra cosa", "tercer texto"]),
                 type=r.choice(["text", "title", None])) for p in range(pages) for i in range(n)]


BOX_DDL = ("page_id bigint, det_id bigint, block_id bigint, cls bigint, x bigint, y bigint, "
           "w bigint, h bigint, confidence double, engine bigint, text string, type string")


def frame(spark, rows, ddl):
    names = [f.split()[0] for f in ddl.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl)


def test_strips_do_not_depend_on_the_tile(spark):
    df = frame(spark, random_boxes(1), BOX_DDL)

    def groups(tile):
        got = scan.strips(df, ["page_id"], F.col("y"), F.col("y") + F.col("h"), tile)
        return {(r.page_id, r.det_id): r.strip for r in got.collect()}

    one = groups(10_000)
    assert groups(37) == one and groups(200) == one
    rows = random_boxes(1)
    for a in rows:
        for b in rows:
            if a["page_id"] == b["page_id"] and bx.overlap_of(a, b) > 0:
                assert one[a["page_id"], a["det_id"]] == one[b["page_id"], b["det_id"]]


def test_scans_match_one_window(spark):
    r = random.Random(3)
    rows = [(r.randrange(2), i, r.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, o bigint, v int").withColumn("b", F.floor(
        F.col("o") / 13))
    got = scan.running_total(df, ["k"], ["o"], "b", F.col("v"), "s")
    got = scan.earlier_max(got, ["k"], ["o"], "b", F.col("v"), "m")
    got = scan.previous(got, ["k"], ["o"], "b", F.col("v"), "p")
    got = scan.latest(got, ["k"], ["o"], "b", F.when(F.col("v") % 7 == 0, F.col("v")), "l")
    by_key = {}
    for row in sorted(got.collect(), key=lambda x: x.o):
        total, top, last, seen = by_key.get(row.k, (0, None, None, None))
        assert (row.m, row.p) == (top, last)
        seen = row.v if row.v % 7 == 0 else seen
        assert (row.s, row.l) == (total + row.v, seen)
        by_key[row.k] = (total + row.v, row.v if top is None else max(top, row.v), row.v, seen)


@pytest.mark.parametrize("large", [(False, False), (True, False), (False, True), (True, True)])
def test_boxes_of_all_sizes_meet(spark, large):
    """Every pair is found once, and a box of a million pixels has at most four cells a level."""
    sides = []
    for k, big in enumerate(large):
        rows = [dict(r, det_id=1000 * k + i, block_id=1000 * k + i, x=r["x"] * 9, y=r["y"] * 9)
                for i, r in enumerate(random_boxes(20 + k))]
        if big:
            rows += [dict(rows[0], block_id=5000 + k * 10 + i, x=-3000 + i, y=i * 700,
                          w=1_000_000 // (i * 40 + 1), h=600 + i * 5000) for i in range(5)]
        sides.append(rows)
    a, b = (jn.prefixed(frame(spark, rows, BOX_DDL).select("page_id", "block_id", *"xywh"), p)
            for rows, p in zip(sides, ("a_", "b_")))
    got = [(r.a_block_id, r.b_block_id) for r in jn.overlap_join(a, b, 0.2, cell=64).collect()]
    want = {(x["block_id"], y["block_id"]) for x in sides[0] for y in sides[1]
            if x["page_id"] == y["page_id"] and bx.overlap_of(x, y) > 0.2}
    assert len(got) == len(set(got)) and set(got) == want
    for left, right in cells.meetings(a, b, ["page_id"], 64):
        for side, key in ((left, "a_block_id"), (right, "b_block_id")):
            rows = side.groupBy("page_id", key, "_level").count()
            assert rows.agg({"count": "max"}).first()[0] <= 4


def greedy(rows, order, ratio, limit, same):
    kept = []
    for row in sorted(rows, key=order):
        if not any(same(row, k) and ratio(row, k) > limit for k in kept):
            kept.append(row)
    return {(k["page_id"], k["det_id"]) for k in kept}


def test_suppression_equals_whole_page_greedy(spark):
    rows = random_boxes(5)
    df = frame(spark, rows, BOX_DDL)
    got = {(r.page_id, r.det_id) for r in bl.suppress_boxes(df, tile=64).collect()}
    assert got == greedy(rows, lambda r: (-r["confidence"], r["y"], r["x"], r["det_id"]),
                         bx.union_ratio_of, 0.35,
                         lambda a, b: a["page_id"] == b["page_id"] and a["cls"] == b["cls"])
    got = {(r.page_id, r.det_id)
           for r in bl.suppress_boxes(df, "min_area", "area", 0.5, tile=64).collect()}
    assert got == greedy(rows, lambda r: (-r["w"] * r["h"], r["y"], r["x"], r["det_id"]),
                         bx.overlap_of, 0.5, lambda a, b: a["page_id"] == b["page_id"])


@pytest.mark.parametrize("first", [3, 64])
def test_suppression_in_rounds_equals_the_fold(spark, monkeypatch, first):
    monkeypatch.setattr(rounds, "FIRST", first)
    rows = random_boxes(11)
    rows += [dict(rows[0], det_id=90_000 + i, x=i * 30, y=10 + i % 3, w=40, h=25,
                  confidence=0.2 + i / 100, block_id=90_000 + i) for i in range(30)]  # a chain
    rows += [dict(rows[0], det_id=91_000 + i, x=0, y=0, w=5000 + i, h=4000, cls=i % 2,
                  block_id=91_000 + i) for i in range(4)]  # far larger than the rest
    df = frame(spark, rows, BOX_DDL)
    for how in (("iou", "score", 0.35), ("min_area", "area", 0.5)):
        whole = bl.suppress_boxes(df, *how, most=10_000)
        apart = bl.suppress_boxes(df, *how, most=0)
        assert sorted(whole.collect()) == sorted(apart.collect())


def test_fusing_in_rounds_equals_the_fold(spark):
    df = frame(spark, random_boxes(13, n=60, height=400), BOX_DDL)
    weights = {0: 1.0, 1: 0.9, 2: 1.1}
    whole = bl.fuse_sources(df, weights, most=10_000).collect()
    apart = bl.fuse_sources(df, weights, most=0).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, apart)) and len(whole) < 180


def test_a_huge_strip_is_decided_in_few_rounds(spark):
    """60,000 boxes in one strip, a third of them in one pile: spread, and done in few rounds."""
    n = F.col("id")
    pile = n % 3 == 0
    boxes = spark.range(60_000).select(
        n.alias("_n"), F.lit(1).alias("page"), F.lit(0).alias("strip"),
        F.when(pile, 100 + n % 7).otherwise(F.pmod(F.hash(n), F.lit(9000))).alias("x"),
        F.when(pile, 100 + n % 11).otherwise(F.pmod(F.hash(n * 7), F.lit(9000))).alias("y"),
        (20 + n % 30).alias("w"), (20 + n % 13).alias("h"), F.xxhash64(n).alias("_rank"))

    def clash(a, b):
        return bx.union_ratio(tuple(map(a, "xywh")), tuple(map(b, "xywh"))) > 0.35

    table = checkpointed(boxes)
    kept, taken = rounds.keep_first(table, ["page", "strip"], clash, higher=2)
    mine = {r["_n"] for r in kept.collect()}
    near, expected = bl._Near([r.asDict() for r in table.collect()]), set()
    rows = sorted((r.asDict() for r in table.collect()), key=lambda r: r["_rank"])
    for k, row in enumerate(rows):
        if not any(bx.union_ratio_of(row, rows[c]) > 0.35 for c in near.of(row)):
            near.add(k, row)
            expected.add(row["_n"])
    assert mine == expected and taken <= 20


def test_suppression_keeps_one_of_many_copies(spark):
    rows = [dict(page_id=1, det_id=i, cls=0, x=5, y=5, w=50, h=20, confidence=i / 5000,
                 block_id=i, engine=0, text="a", type=None) for i in range(4000)]
    got = bl.suppress_boxes(frame(spark, rows, BOX_DDL)).collect()
    assert [r.det_id for r in got] == [3999]


def test_fused_readings(spark):
    df = frame(spark, random_boxes(7), BOX_DDL)
    whole = bl.fuse_sources(df, {0: 1.0, 1: 0.9, 2: 1.1}, tile=100_000).collect()
    cut = bl.fuse_sources(df, {0: 1.0, 1: 0.9, 2: 1.1}, tile=50).collect()
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, cut), key=str)
    assert len(cut) < 120
    for a in cut:
        for b in cut:
            if a.page_id == b.page_id and a.block_id < b.block_id and a.text == b.text:
                assert bx.overlap_of(a.asDict(), b.asDict()) <= 0.40


def test_agreement_raises_confidence_by_type(spark):
    rows = [dict(page_id=1, block_id=i, det_id=i, cls=0, x=0, y=0, w=100, h=20, confidence=c,
                 engine=e, text="capitulo", type=t)
            for i, (e, c, t) in enumerate([(0, 0.5, None), (1, 0.4, "title")])]
    got = bl.fuse_sources(frame(spark, rows, BOX_DDL), {0: 1.0, 1: 0.9}).collect()
    assert len(got) == 1 and got[0].engine == 0 and abs(got[0].confidence - 0.7) < 1e-9


def test_one_engine_passes_through(spark):
    rows = [dict(r, engine=0) for r in random_boxes(8, pages=1)]
    got = bl.fuse_sources(frame(spark, rows, BOX_DDL), {0: 1.0})
    assert got.count() == len(rows)


def test_lines_merge_across_then_down(spark):
    rows = [(1, 1, 10, 10, 50, 20, "HOLA", 0.8, 12), (1, 2, 70, 12, 60, 20, "MUNDO", 0.6, 14),
            (1, 3, 12, 40, 100, 20, "otra linea", 0.7, 12),
            (1, 4, 10, 500, 80, 20, "lejos", 0.9, 12)]
    df = spark.createDataFrame(rows, "page_id bigint, block_id bigint, x bigint, y bigint, "
                                     "w bigint, h bigint, text string, confidence double, "
                                     "font_size bigint").withColumn("type", F.lit(None).cast(
                                         "string"))
    across = bl.merge_lines_horizontal(df)
    assert sorted(r.text for r in across.collect()) == ["HOLA MUNDO", "lejos", "otra linea"]
    down = {r.text: r for r in bl.merge_lines_vertical(across).collect()}
    assert set(down) == {"HOLA MUNDO otra linea", "lejos"}
    top = down["HOLA MUNDO otra linea"]
    assert (top.x, top.y, top.w, top.h, top.font_size, top.n_merged) == (10, 10, 120, 50, 14, 3)


def test_types_keep_lines_apart(spark):
    rows = [(1, 1, 0, 0, 50, 20, "a", 0.5, "title"), (1, 2, 60, 0, 50, 20, "b", 0.5, "sfx"),
            (1, 3, 120, 0, 50, 20, "c", 0.5, "text")]
    df = spark.createDataFrame(rows, "page_id bigint, block_id bigint, x bigint, y bigint, "
                                     "w bigint, h bigint, text string, confidence double, "
                                     "type string")
    assert sorted((r.text, r.type) for r in bl.merge_lines_horizontal(df).collect()) == [
        ("a c", "title"), ("b", "sfx")]


def test_merging_loses_nothing_and_ignores_tiles(spark):
    df = frame(spark, random_boxes(11, n=60), BOX_DDL)
    wide = bl.merge_lines_horizontal(df, tile=100_000).collect()
    assert sum(r.n_merged for r in wide) == 180
    assert sorted(map(str, wide)) == sorted(map(str, bl.merge_lines_horizontal(df, 40).collect()))
    tall = bl.merge_lines_vertical(df, tile=100_000).collect()
    assert sum(r.n_merged for r in tall) == 180
    assert sorted(map(str, tall)) == sorted(map(str, bl.merge_lines_vertical(df, None, 40)
                                                .collect()))


def test_paragraphs(spark):
    rows = [(1, i, 10, 10 + 22 * i, 200, 20, f"linea  {i}", 12) for i in range(3)]
    rows.append((1, 9, 10, 400, 200, 20, "aparte", 13))
    df = spark.createDataFrame(rows, "page_id bigint, block_id bigint, x bigint, y bigint, "
                                     "w bigint, h bigint, text string, font_size bigint")
    got = {r.text: r.n_lines for r in bl.group_text_lines(df).collect()}
    assert got == {"linea 0 linea 1 linea 2": 3, "aparte": 1}


def test_scoring_of_two_gold_boxes(spark):
    gold = spark.createDataFrame([(1, 0, 0, 0, 0, 10, 10), (1, 1, 1, 100, 0, 10, 10)],
                                 "page_id bigint, gold_id bigint, cls bigint, x bigint, y bigint, "
                                 "w bigint, h bigint")
    dets = spark.createDataFrame([(1, 0, 0, 1, 1, 10, 10), (1, 1, 0, 300, 300, 10, 10)],
                                 "page_id bigint, det_id bigint, cls bigint, x bigint, y bigint, "
                                 "w bigint, h bigint")
    pages = spark.createDataFrame([(1, 1000, 1000), (2, 10, 10)],
                                  "page_id bigint, page_w bigint, page_h bigint")
    r = sc.score_detections(gold, dets, pages).collect()[0]
    assert (r.hits, r.fns, r.fps, r.recall, r.precision, r.score) == (1, 1, 1, 0.5, 0.5, 50)
    empty = [x for x in sc.page_scores(gold, dets, pages).collect() if x.page_id == 2][0]
    assert (empty.recall, empty.precision) == (1.0, 1.0)


def test_greedy_match_equals_whole_page(spark):
    rows = random_boxes(21, pages=2, n=50)
    gold = [r for r in rows if r["det_id"] % 2]
    dets = [r for r in rows if not r["det_id"] % 2]
    expected = {}
    for p in range(2):
        taken = set()
        for g in (g for g in gold if g["page_id"] == p):
            for d in dets:
                if d["page_id"] == p and d["det_id"] not in taken and bx.overlap_of(g, d) > 0.3:
                    taken.add(d["det_id"])
                    break
        expected[p] = len(taken)
    g = frame(spark, gold, BOX_DDL).withColumnRenamed("det_id", "gold_id")
    pages = spark.createDataFrame([(0, 500, 1000), (1, 500, 1000)],
                                  "page_id bigint, page_w bigint, page_h bigint")
    got = sc.page_scores(g, frame(spark, dets, BOX_DDL), pages, tile=64).collect()
    assert {r.page_id: r.hits for r in got} == expected


# --- memory ----------------------------------------------------------------------------------

def events_frame(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id bigint, source string, translation string, source_lang string, "
              "target_lang string, quality double, t double, event_id bigint").withColumn(
        "ts", F.timestamp_seconds("t"))


def memory_model(rows):
    state = {}
    for doc, source, shown, _, _, q, t, _ in sorted(rows, key=lambda r: (r[6], r[7])):
        if q < 0.65 or source.lower() == shown.lower():
            continue
        e = state.get((doc, source))
        if e is None:
            state[doc, source] = [shown, q, 1, t, t]
            continue
        e[4] = t
        if e[0] == shown:
            e[1], e[2] = max(e[1], q), e[2] + 1
        elif q >= e[1] + 0.12:
            e[:3] = [shown, q, 1]
        else:
            e[2] += 1
    return state


def test_memory_equals_a_plain_fold(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(r.randrange(2), r.choice("ab"), r.choice(["X", "Y", "Z", "a"]), "ja", "es",
                 r.randrange(50, 101) / 100, BASE + i * r.choice([1, 500]), i) for i in range(400)]
        got = me.learn_memory(events_frame(spark, rows), slice_s=300).collect()
        want = memory_model(rows)
        assert len(got) == len(want)
        for g in got:
            shown, q, n, first, last = want[g.doc_id, g.source_key]
            assert (g.translation, g.occurrences) == (shown, n)
            assert abs(g.quality - q) < 1e-9
            assert (g.first_seen, g.last_seen) == (first, last)


def test_memory_replaces_only_when_clearly_better(spark):
    base = (1, "田中", "ja", "es")

    def learned(*pairs):
        rows = [(base[0], base[1], t, base[2], base[3], q, BASE + i, i)
                for i, (t, q) in enumerate(pairs)]
        return me.learn_memory(events_frame(spark, rows)).collect()[0].translation

    assert learned(("Tanaka", 0.82), ("Tanako", 0.84)) == "Tanaka"
    assert learned(("Tanaka", 0.70), ("Tanako", 0.94)) == "Tanako"


def test_variant_needs_one_neighbour(spark):
    mem = spark.createDataFrame(
        [(1, "田中さん", "ja", "es", "Tanaka-san", 2, 0.95, BASE),
         (1, "山田", "ja", "es", "Yamada", 3, 0.95, BASE), (1, "山口", "ja", "es", "Yamaguchi", 3,
                                                          0.95, BASE),
         (1, "黒崎先", "ja", "es", "weak", 1, 0.95, BASE)],
        "doc_id bigint, source_key string, source_lang string, target_lang string, "
        "translation string, occurrences bigint, quality double, last_seen double")
    asked = spark.createDataFrame(
        [(1, t, "ja", "es") for t in ("田中さ人", "田中さ", "田中さんん", "山子", "黒崎生", "田中さん")],
        "doc_id bigint, text string, source_lang string, target_lang string")
    got = {r.text: r.variant_result for r in me.memory_lookup_variant(
        asked, mem, BASE + 10).collect()}
    assert got == {"田中さ人": "Tanaka-san", "田中さ": "Tanaka-san", "田中さんん": "Tanaka-san",
                   "山子": None, "黒崎生": None, "田中さん": None}


# --- sequences -------------------------------------------------------------------------------

def calls_frame(spark, seed, n=400):
    r = random.Random(seed)
    t, rows = BASE, []
    for i in range(n):
        t += r.choice([1, 5, 30, 30, 200, 90000])
        rows.append((r.randrange(2), i, t, r.random() < 0.7, r.choice([0, 0, 3]),
                     r.choice([0.5, 3.0])))
    return rows, spark.createDataFrame(
        rows, "client bigint, event_id bigint, t double, unchanged boolean, n_blocks bigint, "
              "elapsed_s double").withColumn("ts", F.timestamp_seconds("t"))


def test_packing_equals_one_pass(spark):
    r = random.Random(4)
    rows = [(d, i, r.randrange(20, 700)) for d in range(3) for i in range(500)]
    df = spark.createDataFrame(rows, "doc bigint, i bigint, height bigint")
    for chunk in (7, 64, 4096):
        got = {(x.doc, x.i): (x.strip_no, x.top) for x in sq.pack_strips(
            df, "doc", "i", chunk=chunk).collect()}
        for d in range(3):
            strip, height = -1, 0
            for _, i, h in (x for x in rows if x[0] == d):
                if height and height + 24 + h <= 1900:
                    top = height + 24
                else:
                    strip, top = strip + 1, 0
                height = top + h
                assert got[d, i] == (strip, top), (chunk, d, i)


def test_near_signatures_find_every_pair(spark):
    r = random.Random(9)
    a = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    b = []
    for v in a:
        u = v + (1 << 63)
        for k in r.sample(range(64), r.randrange(0, 7)):
            u ^= 1 << k
        b.append(u - (1 << 63))
    fa, fb = (spark.createDataFrame([(v,) for v in x], "bits bigint") for x in (a, b))
    got = {(x.bits_a, x.bits_b) for x in sq.near_signatures(fa, fb).collect()}
    mask = (1 << 64) - 1
    assert got == {(v, u) for v in set(a) for u in set(b)
                   if bin((v ^ u) & mask).count("1") <= 4}


def test_chained_scans_read_their_source_twice_at_most(spark, tmp_path):
    """The first scan of a chain is written, so the plan of the second does not read the source."""
    path = str(tmp_path / "calls")
    spark.createDataFrame([(i, i % 3, i % 2, 0.5, i * 10) for i in range(60)],
                          "event_id long, client long, n_blocks long, elapsed_s double, at long"
                          ).withColumn("ts", F.timestamp_seconds("at")).write.parquet(path)
    calls = spark.read.parquet(path)
    for made in (sq.rate_limit(calls, 5, 9), sq.fast_empty_streaks(calls, ["client"]),
                 me.alive_intervals(calls, ["client"], 15.0)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert path not in plan and plan.count("Relation [") <= 2
    limited = sq.rate_limit(calls, 5, 9).orderBy("event_id").collect()
    assert [r.day_n for r in limited] == [i // 3 + 1 for i in range(60)]
