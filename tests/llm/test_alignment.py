from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockflow.llm import alignment
from blockflow.llm.alignment import FIRST, SECOND, TwoTokenizers, align, merge, squeeze, stretch
from blockflow.llm.bpe import byte_letters


@pytest.fixture(scope="module")
def both():
    return TwoTokenizers(*map(public_tokenizers.path, (FIRST, SECOND)))


def whole(both, text):
    """Tokens of the whole text as (bytes, id), or none."""
    letters = {c: b for b, c in enumerate(byte_letters())}
    if not text:
        return [], []
    e = both.first.encode(" " + text, add_special_tokens=False)
    a = [(bytes(letters[c] for c in t), i) for t, i in zip(e.tokens, e.ids, strict=True)]
    b = []
    for i in both.second.encode(text):
        p = both.second.id_to_piece(i)
        b.append((bytes([int(p[3:5], 16)]) if both.second.is_byte(i)
                  else p.replace("▁", " ").encode(), i))
    raw = (" " + text).encode()
    good = all(b"".join(t for t, _ in x) == raw for x in (a, b))
    return (a, b) if good else ([], [])


def brute(both, rows):
    cut, counts = [], Counter()
    for doc_id, text in rows:
        a, b = whole(both, text)
        ends = []
        for tokens in (a, b):
            total, at = 0, {}
            for n, (t, _) in enumerate(tokens, 1):
                total += len(t)
                at[total] = n
            ends.append(at)
        groups, i, j = [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][end], ends[1][end]
            groups.append(([t for _, t in a[i:x]], [t for _, t in b[j:y]]))
            i, j = x, y
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        cut.append((doc_id, len(a), len(b), groups, links))
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    return sorted(((doc_id, na, nb, len(groups), len(links),
                    sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
                    sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y))
                                    for x, y in groups).encode()).hexdigest() if na else "")
                   for doc_id, na, nb, groups, links in cut), key=repr)


ODD = ["x ", " ", "  ", "\n", "a\n", "a\nb", "a\n\nb", "a \n b", "a\n b", "a\t  b", "\ta", "▁a",
       "a▁b", "<0x41> <s> </s> <unk>", "<|endoftext|>", "don't 've", "a b  c", "é é",
       "日本語 テキスト", "\U0001f600\U0001f601 x", "a\x00b", "a\x1c b", "tab\r\n  x", "{\r\n}", ";\r",
       "1234 56.78", "   many   blanks   ", "Ａ", "　x", "a b c", "x\x85\ny"]


def test_parts_give_the_tokens_of_the_whole_text(both):
    assert both.in_parts
    for text in ODD:
        parts = both.parts(text)
        assert "".join(parts) == " " + text
        a = [i for p in parts for i in both.first.encode(p, add_special_tokens=False).ids]
        b = [i for ids in both.second_ids(parts) for i in ids]
        assert a == both.first.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert b == both.second.encode(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab .,'\n\t\r é日1<>|\x1c"), min_size=1, max_size=30))
def test_parts_of_any_text(both, text):
    parts = both.parts(text)
    assert [i for p in parts for i in both.first.encode(p, add_special_tokens=False).ids] == \
        both.first.encode(" " + text, add_special_tokens=False).ids
    assert [i for ids in both.second_ids(parts) for i in ids] == both.second.encode(text)


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab .,'\n\t ▁é日1"), min_size=1, max_size=20),
                      min_size=1, max_size=9))
def test_joined_parts_give_what_each_gives_alone(both, texts):
    parts = list(dict.fromkeys(p for t in texts for p in both.parts(t)))
    made = both._make(parts)
    assert made == [both._make([p])[0] for p in parts]
    for part, found in zip(parts, made, strict=True):
        assert (found is None) == ("▁" in part)


def test_squeezed_arrays_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        columns = [rng.integers(-2**62, 2**62, n) for _ in range(3)]
        assert all((x == y).all() for x, y in zip(columns, stretch(squeeze(*columns)),
                                                  strict=False))


@pytest.mark.parametrize("page", [1, 3, 8192])
def test_merged_runs_are_the_counts(monkeypatch, page):
    monkeypatch.setattr(alignment, "PAGE", page)
    rng = np.random.default_rng(page)
    runs, counts = [], Counter()
    for n in (0, 1, 40, 200, 3, 77):
        pairs = np.unique(rng.integers(0, 150, n))
        totals = rng.integers(1, 9, len(pairs))
        counts.update(dict(zip(pairs.tolist(), totals.tolist(), strict=True)))
        runs.append(squeeze(np.diff(pairs, prepend=0), totals))
    pairs, totals = merge(runs)
    assert list(zip(pairs.tolist(), totals.tolist(), strict=True)) == sorted(counts.items())


def test_alignment_against_brute_force(spark, both, small, edge_docs, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(list(enumerate(ODD, 10_000)), docs.schema)
    rows = docs.union(odd).union(edge_docs.select("doc_id", "text")).repartition(9)
    mine = sorted((tuple(r) for r in align(rows).collect()), key=repr)
    assert mine == brute(both, [tuple(r) for r in rows.collect()])
    assert align(no_docs).collect() == []


def test_many_rounds_of_merging(spark, both, small, monkeypatch):
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(80)
    rows = docs.repartition(7)
    mine = sorted((tuple(r) for r in align(rows).collect()), key=repr)
    assert mine == brute(both, [tuple(r) for r in docs.collect()])
