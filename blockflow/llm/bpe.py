"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

The rank file becomes a sentencepiece BPE model without any training: every byte is written as one
printable character, a piece's score is its negative rank, and the normaliser changes nothing.
Merging the best-scored neighbours first is then the same as merging by rank. Texts are cut by the
pattern first and every match is encoded separately. Decoding maps ids back to bytes.

Defined results: a null text is an empty one and gives no ids; repeated rows are encoded each for
themselves; extra columns are not read; an empty table gives an empty result. Any text length
works: a document is handled alone, and documents go through a task in parts of bounded size.
"""

import base64
from array import array
from collections.abc import Iterator
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.llm.common import Memo, slices, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_letters() -> str:
    """One printable character for each byte: Latin-1 where it prints, the rest above U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in prints else next(spare)) for b in range(256))


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a serialised sentencepiece BPE model; a piece's id is its rank."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    letters = byte_letters()
    model = proto.ModelProto()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    for rank, token in enumerate(by_rank):
        model.pieces.add(piece=token.decode("latin-1").translate(
            {b: letters[b] for b in range(256)}), score=-float(rank))
    model.pieces.add(piece="<unk>", type=proto.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(by_rank) + 1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one process, from the serialised model."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        back = {c: b for b, c in enumerate(letters)}
        n = self.processor.vocab_size() - 1
        self.pieces = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(n)]
        self.whole = {piece: i for i, piece in enumerate(self.pieces)}
        self.runs = regex.compile(r"\s\s").search
        self.memo, self.chunks = Memo(), Memo()

    def _encode_all(self, pre_tokens: list[str]) -> list[bytes]:
        """Whole tokens are looked up; the model merges the others."""
        raw = [p.encode() for p in pre_tokens]
        known = [self.whole.get(r) for r in raw]
        others = iter(self.processor.encode(
            [r.decode("latin-1").translate(self.letters)
             for r, k in zip(raw, known, strict=True) if k is None], num_threads=1))
        return [pack("<i", k) if k is not None else array("i", next(others)).tobytes()
                for k in known]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [self.cut(" " + c) for c in chunks]
        pre_tokens = list({p for c in cut for p in c})
        made = dict(zip(pre_tokens, self.memo.each(pre_tokens, self._encode_all), strict=True))
        return [b"".join(map(made.__getitem__, c)) for c in cut]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers.

        Where no two blanks meet, every match lies between two spaces or starts with one, so a
        space and what follows it can be looked up at once.
        """
        if self.runs(text):
            return self.memo.join(self.cut(text), self._encode_all)
        first, *chunks = text.split(" ")
        return (self.memo.join(self.cut(first), self._encode_all)
                + self.chunks.join(chunks, self._encode_chunks))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str, model) -> Codec:
    """One codec per process, vocabulary and pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(model.value, pattern)
    return _codecs[path, pattern]


def _shared_model(spark: SparkSession, path: str):
    """The model as a broadcast; its size is that of the vocabulary file."""
    return spark.sparkContext.broadcast(sentencepiece_model(read_ranks(path)))


def encode(docs: DataFrame, path: str | None = None,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the ids of every whole text."""
    path = path or public_tokenizers.path(VOCABULARY)
    model = _shared_model(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern, model)
        for part in slices(batches):
            encoded = [codec.encode(t or "") for t in part.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(e) // 4 for e in encoded)], dtype=np.int32)
            ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]),
                                        [None, pa.py_buffer(b"".join(encoded))])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), ids)],
                ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The encoded rows with the bytes that their ids stand for, as column decoded.

    A null list of ids is an empty one.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    model = _shared_model(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, public_tokenizers.PATTERN, model)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [codec.decode(np.asarray(ids.values)) if ids.is_valid else b""
                         for ids in part.column("ids")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), pa.array(texts, pa.binary())],
                    ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLES: dict[str, str] = {}
