import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blockflow.llm import bpe, packing

PATH = public_tokenizers.path(bpe.VOCABULARY)
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(bpe.sentencepiece_model(RANKS), public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS,
                             special_tokens={})
WORDS = packing.WordTokens(public_tokenizers.path(packing.VOCABULARY))
TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
ODD = "ab S<|endoftext|> cdeé  \n\t　\x1c\x85​'sll1234½٣!!  \U0001F600ſ̈́İΣ"
TEXTS = st.text(alphabet=ODD, max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_tiktoken_and_decode_back(text):
    ids = np.frombuffer(CODEC.encode(text), "<i4")
    assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
    assert CODEC.decode(ids).decode() == text


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_word_tokens_are_those_of_the_tokenizer(text):
    ids = np.frombuffer(WORDS.encode([text])[0], "<u4").tolist()
    assert ids == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_whole_documents(spark, edge_docs, no_docs):
    rows = bpe.decode(bpe.encode(edge_docs)).collect()
    texts = edge_docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded).decode()) for r in rows) == sorted(
        (r.doc_id if r.doc_id else r.doc_id or -1, r.text or "") for r in texts)
    by_text = {bytes(r.decoded).decode(): r.ids for r in rows}
    assert all(ids == TIKTOKEN.encode_ordinary(t) for t, ids in by_text.items())
    assert bpe.encode(no_docs).count() == 0


def test_digests(spark, small):
    for r in bpe.op2_byte_bpe(spark, small).limit(20).collect():
        text = spark.read.parquet(f"{small}/documents.parquet").filter(
            f"doc_id = {r.doc_id}").first().text or ""
        ids = TIKTOKEN.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def check_packing(rows, texts):
    """Every id in one piece, pieces gapless in sequences; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, packing.END]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            piece = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(piece)
            at += r.length
        assert at == len(ids)
    padding = 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return padding


def test_packing_keeps_every_id(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.op3_packing(spark, small).collect()
    total = sum(r.length for r in rows)
    assert check_packing(rows, {r.doc_id: r.text for r in docs.collect()}) <= total // 50


def test_packing_of_odd_rows(spark, edge_docs, no_docs):
    rows = packing.pack(edge_docs, keep_ids=True).collect()
    assert all(len(r.ids) == r.length for r in rows)
    whole = {}
    for r in edge_docs.collect():
        whole.setdefault((r.doc_id, r.text), 0)
        whole[r.doc_id, r.text] += 1
    tokens = sum(n * (len(TOKENIZER.encode(t or "", add_special_tokens=False).ids) + 1)
                 for (_, t), n in whole.items())
    assert sum(r.length for r in rows) == tokens
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(no_docs).count() == 0


def test_fill_is_the_closest_sum():
    random.seed(3)
    for _ in range(60):
        left = {random.randint(1, 40): random.randint(1, 3) for _ in range(6)}
        used, capacity = random.randint(0, 20), 97  # no power of two above 64 fits often
        chosen = packing.fill(left, used, capacity)
        assert all(n <= left[length] for length, n in chosen.items())
        sums = {0}
        for length, n in left.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        sums = {s for s in sums if s <= capacity - used}
        got = sum(length * n for length, n in chosen.items())
        assert got in sums
        padding = [0 if (used + s) == capacity or (used + s) & (used + s - 1) == 0 and used + s
                   else capacity - used - s for s in sums]
        assert min(padding) == (0 if used + got == capacity or (
            used + got and (used + got) & (used + got - 1) == 0) else capacity - used - got)
