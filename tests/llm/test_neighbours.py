import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from blockflow.llm import curves, packing, sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_groups(texts):
    """component by id, all pairs compared through shared shingles."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter()
        for s in sets[i]:
            common.update(holders[s])
            holders[s].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def check_groups(rows, texts):
    expected = brute_groups(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_groups_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check_groups(sketches.op8_near_duplicates(spark, small).collect(),
                 {r.doc_id: r.text for r in docs.collect()})


def test_near_groups_around_the_limit(spark):
    """Chains and stars of edited copies, a passage that many share, short texts."""
    chance = random.Random(5)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(40)]
    texts = ["one two three", "One two THREE", "one two", ""]
    for edits in range(1, 12):
        for _ in range(6):
            copy = list(base)
            for _ in range(edits):
                copy[chance.randrange(120)] = word()
            texts.append(" ".join(copy))
    chain = list(base[::-1])
    for _ in range(20):
        chain[chance.randrange(120)] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(passage + [word() for _ in range(n)]) for n in range(0, 60, 2)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_groups(sketches.near_groups(frame).collect(), dict(enumerate(texts)))


def test_near_groups_of_odd_rows(spark, edge_docs, no_docs):
    found = Counter((r.doc_id, r.component_id, r.kept)
                    for r in sketches.near_groups(edge_docs).collect())
    assert found[(6, 0, False)] == 2 and found[(0, 0, True)] == 1
    assert found[(1, 1, True)] == found[(2, 2, True)] == 1
    assert found[(None, None, True)] == 2
    assert sum(found.values()) == edge_docs.count()
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"),
                                 (3, "u v w x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in sketches.near_groups(two).collect()} == {
        (1, 1), (2, 1), (3, 1)}
    assert sketches.near_groups(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    roots = {r.node: r.root for r in sketches.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[i] == 100 for i in range(100, 130))
    assert sketches.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = curves.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def nearest(x, ids, query, k):
    scores = x @ x[query]
    scores[query] = -np.inf
    return ids[np.lexsort((ids, -scores))[:k]]


def test_recall_of_nearest(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in curves.search(spark.read.parquet(f"{folder}/embeddings.parquet")).orderBy(
            "query_id", "rank").collect():
        got[r.query_id].append(r)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        found = got[int(ids[q])]
        hits += len({r.vec_id for r in found} & set(nearest(x, ids, q, 20).tolist()))
        total += 20
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(abs(x[q] @ x[np.flatnonzero(ids == r.vec_id)[0]] - r.score) < 1e-12
                   for r in found)
    assert len(got) == (ids % 20 == 0).sum() and hits / total >= 0.9


def test_recall_in_a_hot_group(spark):
    """Two thirds of the rows are copies of one vector, or vectors very close to another."""
    random_ = np.random.default_rng(3)
    x = random_.normal(size=(24_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1::3] = x[1]
    x[2::3] = x[2] + random_.normal(size=(8_000, 64)) * 0.001
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1::3] = x[1]
    ids = np.arange(len(x))
    frame = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": x.tolist()}))
    got = defaultdict(list)
    for r in curves.search(frame, query_step=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for group in (1, 2):
        queries = [q for q in range(0, len(x), 100) if q % 3 == group]
        hits = 0
        for q in queries:
            scores = np.cumsum(x * x[q], axis=1)[:, -1]
            scores[q] = -np.inf
            hits += len(set(got[q]) & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
            assert len(got[q]) == 20 and q not in got[q]
        assert hits / len(queries) / 20 >= 0.9, (group, hits / len(queries) / 20)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]),
            (5, [float("inf"), 1.0]), (6, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [1.0]), (None, [1.0, 1.0]),
            (20, [0.0, 1.0]), (40, [0.0, 1.0]), (40, [0.0, 1.0]), (60, [])]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows],
                                  "vec_id long, embedding array<float>, score double")
    got = defaultdict(list)
    for r in curves.search(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40}
    assert got[0] == [(6, 0.5), (7, 0.5), (20, 0.0), (40, 0.0)]
    assert got[40] == [(20, 1.0), (6, 0.5), (7, 0.5), (0, 0.0)]
    assert curves.search(frame.limit(0)).count() == 0


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns
        assert docs.count() <= before
    left = {r.doc_id: r.text for r in docs.collect()}
    groups = brute_groups({r.doc_id: r.text for r in corpus_pipeline.STAGES[1][1](
        spark, corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(
            f"{small}/documents.parquet"), small), small).collect()})
    assert set(left) == {i for i, (_, c) in groups.items() if i == c}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == set(left)
    assert packing.CAPACITY >= max(r.length for r in rows)


def test_stages_take_odd_rows(spark, edge_docs, small):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (edge_docs, edge_docs.limit(0)):
            found = stage(spark, docs, small)
            assert found.columns == edge_docs.columns
            assert found.filter(F.lit(True)).count() <= edge_docs.count()
