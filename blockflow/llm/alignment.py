"""Alignment of two tokenizers, and how often their tokens are linked in the whole corpus.

A text, with a space before it, is cut by two tokenizers. Where a token of both ends lies a cut of the
text into groups; the two tokens that end there are linked. How good a link is shows in the corpus: a
pair's count against the highest count of any pair of its second token.

Counting is external. Documents go through a task in blocks; a block's records (pair, document, times),
sorted with the second tokenizer's token first, are dealt by that token's low digits into runs,
compressed with zstd. A run keeps its pairs with their totals apart from its documents, so a frequent
pair is one entry per block however many documents hold it, and counting moves only those.
Merging takes up to ``FAN_IN`` runs of one digit at a time, pages in the order of a heap, round by round
until one run per digit is left. As all pairs of a token stand together there, the last merge marks
the highest. Runs are then held against the merged run of their digit, several copies of which
share the work, and their records stream the counts back to documents: one packed row per block and
digit, added up by block.

Texts are looked up in parts. No token of either vocabulary crosses the start of a blank or line
that follows a letter or sign; where the files do not promise that, texts are encoded whole.

Defined results: a text that is null or empty, or that either tokenizer does not give back byte by byte,
has no tokens: all zeros and an empty string; repeated rows count each for themselves, a null id is like any other;
extra columns are not read; an empty table gives an empty result. What a block holds grows with
its longest text, everything else is bounded by the pages of a merge and the pairs of one digit.
"""

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heapreplace
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.llm.bpe import byte_letters
from blockflow.llm.common import Memo, slices, table
from blockflow.session import checkpointed

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
DIGITS = 5  # bits of the second token by which runs are dealt
FAN_IN = 64
PAGE = 8192
JOINED = 64
_IDS, _DOCS = 20, 20  # bits of a token id, and of a document's number in its block
_PART = re.compile(r"(?<=\S)(?= |\n\S)")
_BARRIER = "\n"


class TwoTokenizers:
    """Both tokenizers, and what is known of parts of texts."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.first_bytes = {i: bytes(letters.get(c, 0) for c in token)
                            for token, i in self.first.get_vocab().items()}
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i)
                             else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(pieces), self.first.get_vocab_size()) > 1 << _IDS:
            raise ValueError(f"a vocabulary has more than {1 << _IDS} tokens")
        size = max(self.first_bytes) + 1
        self.first_sizes = np.array([len(self.first_bytes.get(i, b"")) for i in range(size)])
        self.second_sizes = np.array([len(x) for x in self.second_bytes])
        # Each id as text, within a group and at its end.
        self.first_text = np.array([b"%d%c" % (i, c) for i in range(size) for c in b",|"],
                                   dtype=object)
        self.second_text = np.array([b"%d%c" % (i, c) for i in range(len(pieces)) for c in b",;"],
                                    dtype=object)
        self.in_parts = self._parts_hold(pieces, second)
        self.known = Memo(250_000)

    def _parts_hold(self, pieces: list[str], second: str) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as proto

        made = json.loads(self.first.to_str())
        cut = made["pre_tokenizer"] or {}
        model = proto.ModelProto()
        with open(second, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        return (made["normalizer"] is None and cut.get("type") == "ByteLevel"
                and cut["use_regex"] and not cut["add_prefix_space"]
                and rules.name == "identity" and rules.add_dummy_prefix
                and rules.escape_whitespaces and not rules.remove_extra_whitespaces
                and not any("▁" in p.lstrip("▁") or _BARRIER in p for p in pieces)
                and [pieces[i] for i in self.second.encode(_BARRIER)] == ["▁", "<0x0A>"])

    def parts(self, text: str) -> list[str]:
        """The text with a space before it, cut where no token of either crosses."""
        return _PART.split(" " + text) if self.in_parts else [" " + text]

    def first_ids(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.first.encode_batch_fast(parts, add_special_tokens=False)]

    def second_ids(self, parts: list[str]) -> list[list[int]]:
        # A space comes before what is encoded; after a line end stands what has none.
        own = [p[0] == " " and len(p) > 1 for p in parts]
        found = self.second.encode([p[1:] if x else _BARRIER + p
                                    for p, x in zip(parts, own, strict=True)], num_threads=1)
        return [ids if x else ids[2:] for ids, x in zip(found, own, strict=True)]

    def _flat(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of all parts, one after the other; None if the bytes of any of them differ."""
        raw = "".join(parts).encode()
        out = []
        for ids, known in ((self.first_ids(parts), self.first_bytes),
                           (self.second_ids(parts), self.second_bytes)):
            flat = list(chain.from_iterable(ids))
            if b"".join([known[i] for i in flat]) != raw:
                return None
            out.append(np.array(flat, dtype=np.int64))
        return tuple(out)

    def _make(self, parts: list[str]) -> list[tuple | None]:
        """Per part its groups as text, its links, and the numbers of tokens; None if bytes differ.

        Parts that end with a letter or sign are encoded many at a time, one after the other.
        """
        joined = []
        solid = [p for p in parts if not p[-1].isspace()] if self.in_parts else []
        if solid:
            joined = ["".join(solid[i:i + JOINED]) for i in range(0, len(solid), JOINED)]
        loose = [p for p in parts if p[-1].isspace()] if solid else parts
        flat = self._flat([*joined, *loose])
        if flat is None:
            good = [self._flat([p]) is not None for p in parts]
            made = iter(self._make([p for p, x in zip(parts, good, strict=True) if x])
                        if any(good) else [])
            return [next(made) if x else None for x in good]
        found = dict(zip([*solid, *loose], self._linked([*solid, *loose], *flat), strict=True))
        return [found[p] for p in parts]

    def _linked(self, parts: list[str], a: np.ndarray, b: np.ndarray) -> list[tuple]:
        last = np.cumsum([len(p.encode()) for p in parts])
        ends_a, ends_b = np.cumsum(self.first_sizes[a]), np.cumsum(self.second_sizes[b])
        at = np.searchsorted(ends_b, ends_a)
        cut_a = ends_b[at] == ends_a
        group_a = np.flatnonzero(cut_a)  # the last token of each group, of both
        group_b = at[group_a]
        cut_b = np.zeros(len(b), dtype=bool)
        cut_b[group_b] = True
        links = (_pair(b[group_b]) | a[group_a]).tobytes()
        # In the text of a group the tokens of the first come before those of the second.
        text = np.empty(len(a) + len(b), dtype=object)
        before = np.append(0, group_b + 1)[np.cumsum(cut_a) - cut_a]
        text[np.arange(len(a)) + before] = self.first_text[2 * a + cut_a]
        upto = (group_a + 1)[np.cumsum(cut_b) - cut_b]
        text[np.arange(len(b)) + upto] = self.second_text[2 * b + cut_b]
        text = text.tolist()
        upto_a, upto_b = (np.searchsorted(e, last, "right") for e in (ends_a, ends_b))
        upto_links = 8 * np.searchsorted(ends_a[group_a], last, "right")
        n_a, n_b = np.diff(upto_a, prepend=0).tolist(), np.diff(upto_b, prepend=0).tolist()
        out, start, first = [], 0, 0
        for x, y, end, to in zip(n_a, n_b, (upto_a + upto_b).tolist(), upto_links.tolist(),
                                 strict=True):
            out.append((b"".join(text[start:end])[:-1], links[first:to], x, y))
            start, first = end, to
        return out

    def each(self, parts: list[str]) -> list[tuple | None]:
        return self.known.each(parts, self._make)


def _pair(second: np.ndarray) -> np.ndarray:
    """A pair without its first token: the second one, low digits in front, so that runs are
    stretches of the sorted pairs and the pairs of a token stand together."""
    digit = second & (1 << DIGITS) - 1
    return (digit << (_IDS - DIGITS) | second >> DIGITS) << _IDS


_tokenizers: dict[tuple[str, str], TwoTokenizers] = {}


def squeeze(*columns: np.ndarray) -> bytes:
    """Integer arrays of one length, as differences where they rise, byte by byte under zstd."""
    planes = [np.frombuffer(np.int64(len(columns[0])).tobytes(), np.uint8)]
    planes += [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).ravel()
               for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes))


def stretch(packed: bytes) -> list[np.ndarray]:
    """The arrays again."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    if not n:
        return [np.zeros(0, dtype=np.int64)] * 4
    return [np.ascontiguousarray(part.reshape(8, n).T).view("<i8").ravel()
            for part in raw[8:].reshape(-1, 8 * n)]


def _steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=0)


_BLOCK = ("block long, digit int, pairs binary, records binary, doc_ids array<long>,"
          " n_a array<long>, n_b array<long>, n_links array<long>, hashes array<string>")
_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4,
          pa.list_(pa.string())]
_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _runs(block: int, links: np.ndarray, docs: np.ndarray) -> Iterator[tuple]:
    """A block's links as one sorted run per digit."""
    keys, times = np.unique(links << _DOCS | docs, return_counts=True)
    pairs = keys >> _DOCS
    docs = keys & (1 << _DOCS) - 1
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    pairs, totals = pairs[starts], np.add.reduceat(times, starts)
    many = np.diff(starts, append=len(keys))
    digits = pairs >> (2 * _IDS - DIGITS)
    for digit in np.unique(digits).tolist():
        low, high = np.searchsorted(digits, [digit, digit + 1])
        here = slice(starts[low], starts[high] if high < len(starts) else len(keys))
        yield (block, digit, squeeze(_steps(pairs[low:high]), totals[low:high], many[low:high]),
               squeeze(docs[here], times[here]), None, None, None, None, None)


def _encode(first: str, second: str, batches: Iterator[pa.RecordBatch]
            ) -> Iterator[pa.RecordBatch]:
    if (first, second) not in _tokenizers:
        _tokenizers[first, second] = TwoTokenizers(first, second)
    both = _tokenizers[first, second]
    task, made = TaskContext.get().partitionId(), 0
    for part in slices(batches):
        for begin in range(0, part.num_rows, 1 << _DOCS):
            block = part.slice(begin, 1 << _DOCS)
            number: defaultdict[str, int] = defaultdict()
            number.default_factory = number.__len__  # each new part gets the next number
            each = [np.array([number[p] for p in both.parts(text)] if text else [], dtype=np.int64)
                    for text in block.column("text").to_pylist()]
            found = both.each(list(number))
            lost = np.array([x is None for x in found], dtype=bool)
            each = [at if not lost[at].any() else at[:0] for at in each]
            groups, packed, n_a, n_b = zip(*(x or (b"", b"", 0, 0) for x in found), strict=True) \
                if found else ((), (), (), ())
            n_a, n_b = np.array(n_a, dtype=np.int64), np.array(n_b, dtype=np.int64)
            n_links = np.array([len(x) >> 3 for x in packed], dtype=np.int64)
            flat = np.concatenate(each)
            size = np.array([len(at) for at in each])
            at = n_links[flat]
            first_link = np.cumsum(n_links) - n_links
            places = np.arange(at.sum()) + np.repeat(first_link[flat] - (np.cumsum(at) - at), at)
            links = np.frombuffer(b"".join(packed), np.int64)[places]
            of_doc = [int(n_links[x].sum()) for x in each]
            name = task << 32 | made
            made += 1
            hashes = [sha256(b";".join([groups[i] for i in x.tolist()])).hexdigest() if n else ""
                      for x, n in zip(each, size.tolist(), strict=True)]
            rows = [(name, -1, None, None, block.column("doc_id").to_pylist(),
                     [int(n_a[x].sum()) for x in each], [int(n_b[x].sum()) for x in each], of_doc,
                     hashes)]
            if len(links):
                rows += _runs(name, links, np.repeat(np.arange(len(each)), of_doc))
            yield _rows(rows)


def merge(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs as one: each pair once, with the sum of its totals.

    A heap orders the runs by the last pair of their page. The smallest of these bounds what can
    be given out: every run gives what it has up to there, and that run goes on to its next page.
    """
    open_runs = []
    for packed in runs:
        steps, totals, *_ = stretch(packed)
        open_runs.append((np.cumsum(steps), totals))
    done = [0] * len(open_runs)
    heap = [(int(pairs[min(PAGE, len(pairs)) - 1]), r, min(PAGE, len(pairs)))
            for r, (pairs, _) in enumerate(open_runs) if len(pairs)]
    heapify(heap)
    out_pairs, out_totals = [], []
    while heap:
        bound, run, end = heap[0]
        here, sums = [], []
        for _, r, page_end in heap:
            pairs, totals = open_runs[r]
            upto = done[r] + int(np.searchsorted(pairs[done[r]:page_end], bound, "right"))
            here.append(pairs[done[r]:upto])
            sums.append(totals[done[r]:upto])
            done[r] = upto
        found, at = np.unique(np.concatenate(here), return_inverse=True)
        total = np.zeros(len(found), dtype=np.int64)
        np.add.at(total, at, np.concatenate(sums))
        out_pairs.append(found)
        out_totals.append(total)
        pairs = open_runs[run][0]
        if end < len(pairs):
            end = min(end + PAGE, len(pairs))
            heapreplace(heap, (int(pairs[end - 1]), run, end))
        else:
            heappop(heap)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *out_pairs]), np.concatenate([none, *out_totals])


def _merge_group(key: tuple, rows: pa.Table) -> pa.Table:
    pairs, totals = merge(rows.column("pairs").to_pylist())
    return pa.table({"digit": pa.array([key[0].as_py()], pa.int32()),
                     "run": pa.array([key[1].as_py()], pa.int64()),
                     "pairs": pa.array([squeeze(_steps(pairs), totals)], pa.binary())})


def count_pairs(runs: DataFrame, blocks: int) -> DataFrame:
    """One run (digit, pairs) per digit with the counts of all ``runs`` (digit, run, pairs)."""
    parts = blocks
    while True:
        parts = -(-parts // FAN_IN)
        part = F.pmod(F.xxhash64("run"), F.lit(parts))
        runs = runs.select("digit", part.alias("run"), "pairs").groupBy("digit", "run").applyInArrow(
            _merge_group, "digit int, run long, pairs binary")
        if parts == 1:
            return checkpointed(runs.drop("run"))


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each run's records add to its documents."""
    for batch in batches:
        for row in batch.to_pylist():
            steps, counts, *_ = stretch(row["counted"])
            pairs = np.cumsum(steps)
            second = np.flatnonzero(np.diff(pairs >> _IDS, prepend=-1))
            highest = np.repeat(np.maximum.reduceat(counts, second),
                                np.diff(second, append=len(pairs)))
            steps, _, many, *_ = stretch(row["pairs"])
            at = np.searchsorted(pairs, np.cumsum(steps))
            docs, times = stretch(row["records"])[:2]
            size = int(docs.max()) + 1
            sums, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
            np.add.at(sums, docs, times * np.repeat(counts[at], many))
            np.add.at(best, docs, times * np.repeat((counts == highest)[at], many))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]]), pa.array([squeeze(best, sums)])], ["block", "added"])


_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long,"
           " count_sum long, groups_sha256 string")


def _finish(key: tuple, rows: pa.Table) -> pa.Table:
    """A block's documents with what its runs add to them."""
    rows = rows.to_pylist()
    docs = next(r for r in rows if r["doc_ids"] is not None)
    best = np.zeros(len(docs["doc_ids"]), dtype=np.int64)
    sums = best.copy()
    for row in rows:
        if row["added"] is not None:
            more, add = stretch(row["added"])[:2]
            best[:len(more)] += more
            sums[:len(add)] += add
    names = [f.split()[0] for f in _RESULT.split(", ")]
    columns = [docs["doc_ids"], docs["n_a"], docs["n_b"], docs["n_links"], docs["n_links"], best,
               sums]
    return pa.table([*(pa.array(c, pa.int64()) for c in columns),
                     pa.array(docs["hashes"], pa.string())], names)


def align(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """Per document the numbers of tokens, groups and links, how many links are the best of their
    second token in the corpus, the sum of the links' counts, and the hash of the groups."""
    first = first or public_tokenizers.path(FIRST)
    second = second or public_tokenizers.path(SECOND)
    rows = checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(lambda batches: _encode(first, second, batches), _BLOCK))
    texts = rows.filter("digit < 0")
    runs = rows.filter("digit >= 0")
    blocks = max(texts.count(), 1)
    counted = count_pairs(runs.select("digit", F.col("block").alias("run"), "pairs"), blocks)
    copies = -(-blocks // FAN_IN)
    counted = counted.select("digit", F.col("pairs").alias("counted"),
                             F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    added = runs.select("block", "digit", "pairs", "records",
                        F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy")).join(
        counted, ["digit", "copy"]).select("block", "pairs", "records", "counted").mapInArrow(
        _contribute, "block long, added binary")
    own = ["doc_ids", "n_a", "n_b", "n_links", "hashes"]
    return texts.select("block", *own).unionByName(added, allowMissingColumns=True).groupBy(
        "block").applyInArrow(_finish, _RESULT)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned and held against the counts of the whole table."""
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op11_alignment": op11_alignment}
ORACLES: dict[str, str] = {}
