from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from blockflow.llm.mixture import CELLS, Mixtures, cells, identify, learn

ENGLISH = "the quick brown fox jumps over the lazy dog and then it sleeps under an old tree "
GERMAN = "der schnelle braune fuchs springt über den faulen hund und schläft unter einem baum "
FRENCH = "le renard brun saute par dessus le chien paresseux puis il dort sous un vieil arbre "


def test_every_letter_counts_alone_and_between_its_neighbours():
    def windows(text):
        letters = [c.lower() if c.isalpha() else " " for c in f" {text} "]
        return [tuple(letters[i - 1:i + 2]) for i in range(1, len(letters) - 1)
                if letters[i] != " "]

    texts = ["Abc, ab!", "", "12 -- 3", "x", "Äb  äb\nc", "日本語 text ab"]
    number, cell = cells(texts)
    seen = {}
    for i, text in enumerate(texts):
        here = cell[number == i].reshape(-1, 2).tolist()
        expected = windows(text)
        assert len(here) == len(expected)
        for (alone, between), window in zip(here, expected, strict=True):
            assert seen.setdefault(alone, window[1]) == window[1]
            assert seen.setdefault(between, window) == window
    assert number.max() < len(texts) and cell.max() < CELLS


def _profiles(rng, languages=4, size=300):
    chance = rng.dirichlet(np.full(size, 0.05), languages)
    return 0.95 * chance + 0.05 * chance.mean(axis=0)


@pytest.mark.parametrize("seed", range(6))
def test_sets_and_shares_against_every_set(seed):
    """The chosen set and its likelihood against an exhaustive search over sets, with shares from
    many steps of a plain expectation-maximisation."""
    rng = np.random.default_rng(seed)
    chance = _profiles(rng)
    truth = np.zeros(4)
    truth[rng.choice(4, 1 + seed % 3, replace=False)] = 1
    truth /= truth.sum()
    n = rng.multinomial(600, truth @ chance).astype(float)
    used = np.flatnonzero(n)
    found = Mixtures(chance, np.zeros(len(used), dtype=int), used, n[used], 1)

    def best(members):
        shares = np.zeros(4)
        shares[list(members)] = 1 / len(members)
        for _ in range(2000):
            shares *= (n / (shares @ chance)) @ chance.T / n.sum()
        return float(n @ np.log(shares @ chance)), shares

    every = {m: best(m) for k in (1, 2, 3, 4) for m in combinations(range(4), k)}
    penalised = {m: v[0] - found.penalty[0] * len(m) for m, v in every.items()}
    mine = tuple(np.flatnonzero(found.members[0]).tolist())
    assert mine == max(penalised, key=penalised.get)
    assert found.likelihood[0] == pytest.approx(every[mine][0], abs=0.5)
    assert np.allclose(found.shares[0], every[mine][1], atol=0.05)
    assert set(mine) == set(np.flatnonzero(truth).tolist())


def test_texts_do_not_touch_each_other():
    rng = np.random.default_rng(9)
    chance = _profiles(rng)
    counts = [rng.multinomial(300, w @ chance).astype(float)
              for w in (np.eye(4)[0], np.array([0.5, 0.5, 0, 0]), np.eye(4)[3])]
    text = np.concatenate([np.full((n > 0).sum(), i) for i, n in enumerate(counts)])
    cell = np.concatenate([np.flatnonzero(n) for n in counts])
    whole = Mixtures(chance, text, cell, np.concatenate([n[n > 0] for n in counts]), 3)
    for i, n in enumerate(counts):
        used = np.flatnonzero(n)
        one = Mixtures(chance, np.zeros(len(used), dtype=int), used, n[used], 1)
        assert np.allclose(one.shares[0], whole.shares[i])
        assert np.allclose(one.scores()[1][0], whole.scores()[1][i])


def test_a_mixed_text_has_its_languages(spark):
    rows = [(i, lang, t * 5) for i, (lang, t) in enumerate(
        [("en", ENGLISH), ("de", GERMAN), ("fr", FRENCH)])]
    profiles = learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    texts = [ENGLISH * 3, GERMAN * 3, ENGLISH * 4 + FRENCH * 2, None, "", "12 + 3", "ξένα"]
    out = {r["doc_id"]: r for r in identify(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string"), profiles).collect()}
    assert [out[i]["lang_pred"] for i in range(6)] == ["en", "de", "en", "und", "und", "und"]
    assert sorted(out[2]["langs"]) == ["en", "fr"] and out[2]["shares"][0] == pytest.approx(
        2 / 3, abs=0.1)
    assert out[0]["score"] > 0.9 and out[3]["score"] == 0
    assert 0 < out[6]["score"] <= 0.5  # nothing known speaks for one of the three


def test_counts_are_exact(spark):
    rows = [("a", "Ab b"), ("a", "ab"), ("b", "ab"), (None, "zz"), ("c", None)]
    profiles = learn(spark.createDataFrame(rows, "lang string, text string"))
    assert profiles.languages == ["a", "b", "c"]
    counted = {lang: Counter() for lang in "abc"}
    for lang, text in rows:
        if lang:
            counted[lang].update(cells([text or ""])[1].tolist())
    used = {c for n in counted.values() for c in n}
    assert all(np.isclose(profiles.chance[:, :1 << 14].sum(axis=1)[:2], 1))
    for k, lang in enumerate("abc"):
        low = profiles.chance[k].min()
        assert {c for c in used if profiles.chance[k][c] > 5 * low} >= set(counted[lang])


def test_odd_rows_and_held_out_accuracy(spark, edge_docs, no_docs):
    assert identify(no_docs, learn(no_docs)).collect() == []
    out = identify(edge_docs, learn(edge_docs)).collect()
    assert len(out) == edge_docs.count()
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "und") for r in out)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(docs, learn(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")))
    judged = [r for r in found.join(docs.select("doc_id", "lang"), "doc_id").collect()
              if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in judged) >= 0.99 * len(judged)
    none = learn(no_docs)
    assert {r["lang_pred"] for r in identify(edge_docs, none).collect()} == {"und"}
