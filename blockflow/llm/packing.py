"""Packing documents into sequences by minimum bin slack.

Documents longer than a sequence are cut into whole sequences and a rest. All that planning needs of
the pieces is how many there are of each length, at most one row per possible length. The planner
takes the longest piece left, lets a subset-sum over bitsets find which of the others fill the
window closest to its capacity, reads the counts back from the steps, and uses the same filling as
often as the counts allow; so its work is bounded by the capacity and does not grow with the
documents. Pieces find their place by their rank among those of equal length.

A window costs its padding: none when it is full, and none at a power of two.

Defined results: a null text is an empty one, its only token is the end token; repeated rows are
packed each for themselves; extra columns are not read; an empty table gives an empty result; the
order of equally long pieces is that of the written rows. Texts may have any length: they are cut
at spaces, and a token never spans one.
"""

import os
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockflow.llm.common import Memo, slices, table
from blockflow.session import checkpointed

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END = 4096, 2
_RANKS = 44  # bits for the rank of a piece among those of its length


class WordTokens:
    """Token ids of texts, with what lies between two spaces looked up.

    The vocabulary is lower case and no token spans a blank, so A-Z may be lowered first and
    closing punctuation be looked up apart from the letters or digits before it.
    """

    CLOSING = ".,;:!?%&#$*"
    MARK = "\ue000"  # stands between parts that are encoded at one go
    JOINED = 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.parts = Memo(), Memo()
        self.mark = np.array(self._ids([self.MARK])[0], dtype=np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _make(self, parts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self._ids(parts)]

    def _make_joined(self, parts: list[str]) -> list[bytes]:
        """The same, many parts at a time: the ids of the mark tell where a part ends."""
        groups = [parts[i:i + self.JOINED] for i in range(0, len(parts), self.JOINED)]
        between, k, out = f" {self.MARK} ", len(self.mark), []
        for group, ids in zip(groups, self._ids([between.join(g) for g in groups]), strict=True):
            ids = np.array(ids, dtype=np.uint32)
            found = np.ones(max(len(ids) - k + 1, 0), dtype=bool)
            for i, m in enumerate(self.mark):
                found &= ids[i:i + len(found)] == m
            ends = np.flatnonzero(found)
            if len(ends) != len(group) - 1:  # a part has the mark itself
                out += self._make(group)
                continue
            raw, start = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[4 * start:4 * end])
                start = end + k
            out.append(raw[4 * start:])
        return out

    def _apart(self, chunk: str) -> list[str]:
        found = []
        for line in chunk.split("\n"):
            stem = line.rstrip(self.CLOSING)
            if stem and len(stem) < len(line) and stem[-1] < "\u0100" and stem[-1].isalnum():
                found += [stem, line[len(stem):]]
            else:
                found.append(line)
        return found

    def _make_chunks(self, chunks: list[str]) -> list[bytes]:
        # A chunk that is one part is encoded at once, the parts of the others are looked up.
        whole = [c for c in chunks if not c or c[-1] not in self.CLOSING and "\n" not in c]
        found = dict(zip(whole, self._make_joined(whole), strict=True))
        apart = {c: self._apart(c) for c in chunks if c not in found}
        parts = list({p for c in apart.values() for p in c})
        made = dict(zip(parts, self.parts.each(parts, self._make_joined), strict=True))
        for chunk, own in apart.items():
            found[chunk] = b"".join([made[p] for p in own])
        return [found[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers. What several texts hold is looked up once."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__  # each new chunk gets the next number
        rows: list[bytes | list[int]] = []
        for text in texts:
            if "<|" in text:  # may hold a special token, which is written in lower case
                rows.append(self.parts.join(text.split(" "), self._make))
            else:
                rows.append([number[c] for c in text.encode().lower().decode().split(" ")])
        made = self.chunks.each(list(number), self._make_chunks)
        return [r if isinstance(r, bytes) else b"".join([made[i] for i in r]) for r in rows]


_tokens: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END,
           keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens.

    part and nth number the pieces of one length within a task; they only hold for one run, so
    the pieces are to be written before they are used.
    """
    last = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = WordTokens(path)
        tokens = _tokens[path]
        part_no, seen = TaskContext.get().partitionId(), Counter()
        for part in slices(batches):
            rows = []
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc_id, found in zip(part.column("doc_id").to_pylist(), tokens.encode(texts),
                                     strict=True):
                ids = memoryview(found + last)
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start:4 * (start + capacity)]
                    n = len(piece) // 4
                    rows.append((doc_id, start, n, zlib.crc32(piece), total, part_no, seen[n],
                                 np.frombuffer(piece, "<i4") if keep_ids else None))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "ids"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long,"
             " nth long, ids array<int>")
    return cut if keep_ids else cut.drop("ids")


def fill(left: dict[int, int], used: int, capacity: int) -> dict[int, int]:
    """Which pieces (length to count) bring a window that holds ``used`` closest to capacity.

    Bit s of ``sums`` says that some choice of the pieces so far has length s. Counts enter as
    powers of two. The steps are kept, and read backwards they give the counts.
    """
    room = capacity - used
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in left if n <= room), reverse=True):
        many, times = min(left[length], room // length), 1
        while many:
            times = min(times, many)
            steps.append((length, times, sums))
            sums |= (sums << (length * times)) & mask
            many, times = many - times, times * 2
        if sums >> room & 1:
            break
    goal = room
    if not sums >> room & 1:
        powers = [p for k in range(capacity.bit_length()) if (p := 1 << k) >= used
                  and p <= capacity and sums >> (p - used) & 1]
        goal = powers[-1] - used if powers else sums.bit_length() - 1
    chosen: Counter = Counter()
    for length, times, before in reversed(steps):
        if not before >> goal & 1:
            chosen[length] += times
            goal -= length * times
    return dict(chosen)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where pieces go. A row says: of the pieces of ``length``, those from rank ``first`` on go to
    windows from ``sequence`` on, ``each`` to a window, the first at ``offset``."""
    left = {n: c for n, c in counts.items() if c > 0}
    taken: Counter = Counter()
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        need = Counter(fill({n: c for n, c in rest.items() if c}, longest, capacity))
        need[longest] += 1
        times = min(left[n] // k for n, k in need.items())
        offset = 0
        for n in sorted(need, reverse=True):
            rows.append((n, taken[n], need[n], sequence, offset))
            taken[n] += times * need[n]
            left[n] -= times * need[n]
            offset += n * need[n]
            if not left[n]:
                del left[n]
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(ranked: DataFrame, rows: np.ndarray) -> DataFrame:
    """Pieces with a rank within their length, with their sequence and offset."""
    keys = (rows[:, 0] << _RANKS) + rows[:, 1]
    shared = ranked.sparkSession.sparkContext.broadcast((rows, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_rows, plan_keys = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = plan_rows[np.searchsorted(plan_keys, (n << _RANKS) + rank, "right") - 1]
            window, within = np.divmod(rank - row[:, 1], row[:, 2])
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(row[:, 3] + window),
                 pa.array(row[:, 4] + within * n)], [*names, "sequence_id", "offset"])

    kept = [f for f in ranked.schema if f.name != "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END,
         keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cut = checkpointed(pieces(docs, path or public_tokenizers.path(VOCABULARY), capacity, end,
                              keep_ids))
    per_task = cut.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    firsts = per_task.select("length", "part",
                             F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n"))
              .collect()}  # at most one row for each length up to the capacity
    ranked = cut.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    return place(ranked.select(*columns, "rank"), plan(counts, capacity))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents as pieces of sequences."""
    return pack(docs)


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
