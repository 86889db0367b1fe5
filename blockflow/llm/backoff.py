"""Language-model scores from a weighted backoff automaton.

Texts are cut into words once, into blocks of a few megabytes. A block sends its distinct words,
pairs and triples of tokens, each with its count in training documents, to the parts of their hash
range; a part adds up what the blocks sent and answers every block with the totals in the order in
which it asked. So every n-gram of the corpus counts, at any size: nothing that grows with the
vocabulary is broadcast or sent to the driver, and a frequent n-gram is one entry per block.

With its totals a block has the part of the model that its documents can meet, and builds it as an
automaton. Contexts (one or two tokens) become states with a failure arc to the next shorter
context, n-grams become arcs. The walk reads the tokens from left to right, each in the state that
those before it led to, and adds up arc and failure weights; that state is always the longest
context which the model has, so arrays hold the walks of all documents of a block. Smoothing is that of the hierarchical Dirichlet model: a context seen c times gives a token
seen n times after it (n + strength * shorter) / (c + strength), where ``shorter`` is the token's
probability after the shorter context and, without context, the add-one estimate of the base score.
An n-gram not seen has the failure weight strength / (c + strength) times that.

Words are counted as they are; pairs and triples by a hash with 20 bits more than their number needs, so
at any size about one in a million shares its count with another.

Defined results: a null text is an empty one and consists of the end token; a null id is not held
out; repeated rows are scored each for themselves and count each when learning; extra columns are
not read; without training documents every base score is 0 and the automaton has no states; an empty
table gives an empty result. A long text makes a block of its own.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest
from zstandard import ZstdCompressor, ZstdDecompressor

from blockflow.llm.common import remainder, table
from blockflow.session import checkpointed

FOLDS, LEFT_OUT = 7, 2
STRENGTHS = 300.0, 10.0  # weight of the shorter context for contexts of one and of two tokens
BLOCK_BYTES = 6_000_000
PART = 4_000_000  # n-grams that a part of the hash range holds on average, at most
WORDS, GRAMS = 0, 1
SPARE = 20  # bits of a key's hash beyond those that the number of n-grams needs

_BLOCK = ("block long, words binary, tokens binary, n long, n_trained long, ends array<int>,"
          " doc_ids array<long>, held_out array<boolean>")
_ASKED = "kind int, part int, block long, keys binary, counts binary"
_TOLD = "block long, kind int, part int, totals binary, n_distinct long"
_SCORE = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
          " base_score double, score double")


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def compress(data: bytes) -> bytes:
    return ZstdCompressor(level=1).compress(data)


def decompress(data: bytes) -> bytes:
    return ZstdDecompressor().decompress(data)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest; the first byte tells how many."""
    kind = np.min_scalar_type(int(counts.max()))
    return bytes([kind.itemsize]) + compress(counts.astype(kind).tobytes())


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def blocks(docs: DataFrame) -> DataFrame:
    """One row per block: its distinct words, and its documents as compressed word numbers, one after
    the other; number 0 is the end of a document. Block numbers only hold for one run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        local: dict[bytes, int] = {b"": 0}
        tokens, ends, ids, held, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(tokens)
            last = np.array(ends)
            trained = int(np.diff(last, prepend=0)[~np.array(held)].sum())
            columns = [[task << 32 | made], [compress(b"\n".join(local))],
                       [compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes())], [len(flat)], [trained],
                       [last.astype(np.int32)], [ids], [held]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(),
                     pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(_BLOCK))

        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(c) for c in ("doc_id", "held_out", "text")),
                                         strict=True):
                raw = (text.as_py() or "").encode()
                if size and size + len(raw) > BLOCK_BYTES:
                    yield block()
                    local, made, size = {b"": 0}, made + 1, 0
                    tokens, ends, ids, held = [], [], [], []
                # Of bytes, lower() and split() know A-Z and the six blanks only.
                tokens.append(np.array([*(local.setdefault(w, len(local))
                                          for w in raw.lower().split()), 0], dtype=np.int32))
                ends.append(len(tokens[-1]) + (ends[-1] if ends else 0))
                ids.append(doc_id.as_py())
                held.append(out.as_py())
                size += len(raw) + 1
        if ids:
            yield block()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(remainder(F.col("doc_id"), FOLDS) == LEFT_OUT, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, _BLOCK)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Well spread 64-bit keys (the finishing steps of splitmix64)."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


class Block:
    """A block's documents with its distinct n-grams, the same whenever they are made anew.

    ``at_pair`` and ``at_triple`` number the n-gram that ends at each token, in the order of
    ``grams``; the first token of a document follows the end token and ends no triple (-1).
    """

    def __init__(self, row: dict, bits: int):
        self.words = decompress(row["words"]).split(b"\n")
        self.tokens = np.ascontiguousarray(np.frombuffer(
            decompress(row["tokens"]), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
        self.ends = np.array(row["ends"])
        hashes = np.fromiter((xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        self.order = np.argsort(hashes, kind="stable")  # of words
        self.hashes = hashes[self.order]
        n = len(self.tokens)
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.before = np.concatenate(([0], self.tokens[:-1])).astype(np.int32)
        self.before[self.starts] = 0
        inner = np.ones(n, dtype=bool)
        inner[self.starts] = False
        self.inner = np.flatnonzero(inner).astype(np.int32)
        of = hashes[self.tokens]
        pairs = _mixed(hashes[self.before] * np.uint64(3) + of)
        triples = _mixed(pairs[self.inner - 1] * np.uint64(5) + of[self.inner] + np.uint64(1))
        keys = np.concatenate((pairs, triples)) >> np.uint64(64 - bits)
        del of, pairs, triples
        order = np.argsort(keys)
        keys = keys[order]
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        self.grams, self.first = keys[fresh], order[fresh]
        number = np.empty(len(keys), dtype=np.int32)
        number[order] = np.cumsum(fresh, dtype=np.int32) - 1
        self.at_pair = number[:n]
        self.at_triple = np.full(n, -1, dtype=np.int32)
        self.at_triple[self.inner] = number[n:]

    def counts(self, held_out: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words (in hash order) and n-grams in the training documents."""
        good = np.repeat(~np.array(held_out), np.diff(self.ends, prepend=0))
        words = np.bincount(self.tokens[good], minlength=len(self.words))[self.order]
        grams = np.bincount(self.at_pair[good], minlength=len(self.grams))
        good[self.starts] = False
        return words, grams + np.bincount(self.at_triple[good], minlength=len(self.grams))


def _cuts(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Parts of the hash range with the places of their keys among the sorted ones."""
    parts, first = np.unique(keys >> np.uint64(shift), return_index=True)
    return list(zip(parts.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def _packed(keys: np.ndarray) -> bytes:
    """Steps between sorted keys, in as many bytes as the widest needs."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _ask(bits: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block has of each part of the hash range."""
    for batch in batches:
        for row in range(batch.num_rows):
            here = batch.slice(row, 1).to_pylist()[0]
            block = Block(here, bits)
            words, grams = block.counts(here["held_out"])
            names = [block.words[i] for i in block.order.tolist()]
            out = [(WORDS, part, here["block"], compress(b"\n".join(names[a:b])),
                    _narrow(words[a:b])) for part, a, b in _cuts(block.hashes, 64 - parts)]
            start = np.uint64(bits - parts)
            out += [(GRAMS, part, here["block"],
                     _packed(block.grams[a:b] - (np.uint64(part) << start)),
                     _narrow(grams[a:b])) for part, a, b in _cuts(block.grams, bits - parts)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                _names(_ASKED))


def _tell(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
    """The totals of one part, for each block in the order of its keys."""
    kind, part = key[0].as_py(), key[1].as_py()
    counts = [_wide(c) for c in asked["counts"].to_pylist()]
    sizes = [len(c) for c in counts]
    if kind == WORDS:
        numbers: dict[bytes, int] = {}
        at = np.array([numbers.setdefault(w, len(numbers)) for data in asked["keys"].to_pylist()
                       for w in decompress(data).split(b"\n")])
    else:
        keys = np.concatenate([_unpacked(d, n) for d, n in
                               zip(asked["keys"].to_pylist(), sizes, strict=True)])
        order = np.argsort(keys)
        keys = keys[order]
        at = np.empty(len(keys), dtype=np.int32)
        at[order] = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])), dtype=np.int32)
        del keys, order
    totals = np.bincount(at, np.concatenate(counts)).astype(np.int64)  # exact below 2**53
    answers = np.split(totals[at], np.cumsum(sizes)[:-1])
    distinct = [int((totals > 0).sum())] + [0] * (len(sizes) - 1)
    return pa.table([asked["block"], pa.array([kind] * len(sizes), pa.int32()),
                     pa.array([part] * len(sizes), pa.int32()),
                     pa.array([_narrow(a) for a in answers], pa.binary()),
                     pa.array(distinct, pa.int64())], _names(_TOLD))


class Automaton:
    """States, arcs and failure arcs of what a block can meet. State 0 knows no context, state
    1 + w follows token w, further ones follow pairs. Arc g is n-gram g, if it was ever seen."""

    def __init__(self, block: Block, words: np.ndarray, grams: np.ndarray, floor: int):
        one, two = STRENGTHS
        self.block, self.known, self.seen = block, words > 0, grams > 0
        self.single = (words + 1.0) / floor
        # Each n-gram at one of the places where it ends.
        n = len(block.tokens)
        pairs = np.flatnonzero(block.first < n)
        triples = np.flatnonzero(block.first >= n)
        ends, last = block.first[pairs], block.inner[block.first[triples] - n]
        self.arcs = np.empty(len(grams))
        self.arcs[pairs] = ((grams[pairs] + one * self.single[block.tokens[ends]])
                            / (words[block.before[ends]] + one))
        self.arcs[triples] = ((grams[triples] + two * self.arcs[block.at_pair[last]])
                              / (grams[block.at_pair[last - 1]] + two))
        np.log10(self.arcs, out=self.arcs)
        np.log10(self.single, out=self.single)
        self.fail = np.zeros(1 + len(words) + len(grams), dtype=np.int32)
        self.fail[1 + len(words) + pairs] = 1 + block.tokens[ends]
        self.back = np.log10(np.concatenate(([1.0], one / (words + one), two / (grams + two))))

    def walk(self) -> np.ndarray:
        """log10 probability of each token of the block in the state before it."""
        block, seen, deepest = self.block, self.seen, len(self.known)
        tokens = block.tokens
        after = np.where(seen[block.at_pair], 1 + deepest + block.at_pair,
                         np.where(self.known[tokens], 1 + tokens, 0)).astype(np.int32)
        state = np.concatenate(([0], after[:-1]))
        state[block.starts] = 1 if self.known[0] else 0
        out = np.zeros(len(tokens))
        left = np.arange(len(tokens), dtype=np.int32)  # tokens whose arc is not found yet
        for arcs, lowest in ((block.at_triple, 1 + deepest), (block.at_pair, 1)):
            # Tokens in a state of this depth take its arc, or go along its failure arc.
            here = state[left] >= lowest
            arc = arcs[left]
            found = here & (arc >= 0) & seen[arc]
            out[left[found]] += self.arcs[arc[found]]
            fall = left[here & ~found]
            out[fall] += self.back[state[fall]]
            state[fall] = self.fail[state[fall]]
            left = left[~found]
        out[left] += self.single[tokens[left]]
        return out


def _scored(bits: int, total: int, distinct: int,
            batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            here = batch.slice(row, 1).to_pylist()[0]
            block = Block(here, bits)
            told = sorted(here["told"], key=lambda t: (t["kind"], t["part"]))
            by_hash, grams = (np.concatenate([_wide(t["totals"]) for t in told if t["kind"] == k])
                              for k in (WORDS, GRAMS))
            words = np.zeros_like(by_hash)
            words[block.order] = by_hash
            automaton = Automaton(block, words, grams, total + distinct + 1)
            sums = [np.add.reduceat(x, block.starts) for x in (
                automaton.known[block.tokens].astype(np.int64), automaton.single[block.tokens],
                automaton.walk())]
            n = np.diff(block.ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(here["doc_ids"], pa.int64()), pa.array(here["held_out"], pa.bool_()),
                 pa.array(n, pa.int64()), pa.array(sums[0]),
                 pa.array([total] * len(n), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
                _names(_SCORE))


def key_bits(n: int) -> tuple[int, int]:
    """Bits of a key's hash and of the number of its part, for n tokens."""
    grams = 2 * max(n, 1)
    return (min(64, SPARE + grams.bit_length()),
            max(1, int(np.ceil(np.log2(max(1, grams / PART))))))


def totals(rows: DataFrame, n: int) -> DataFrame:
    """The corpus totals of the words and n-grams of each block, part by part, for n tokens."""
    return rows.select("block", "words", "tokens", "ends", "held_out").mapInArrow(
        partial(_ask, *key_bits(n)), _ASKED).groupBy("kind", "part").applyInArrow(_tell, _TOLD)


def score(docs: DataFrame) -> DataFrame:
    """Every document's base score and automaton score."""
    rows = checkpointed(blocks(docs))
    n, total = (x or 0 for x in rows.agg(F.sum("n"), F.sum("n_trained")).first())
    told = checkpointed(totals(rows, n))
    distinct = told.filter(F.col("kind") == WORDS).agg(F.sum("n_distinct")).first()[0] or 0
    answers = told.groupBy("block").agg(
        F.collect_list(F.struct("kind", "part", "totals")).alias("told"))
    return rows.select("block", "words", "tokens", "ends", "doc_ids", "held_out").join(
        answers, "block").mapInArrow(partial(_scored, key_bits(n)[0], total, distinct), _SCORE)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those outside the held-out fold."""
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLES: dict[str, str] = {}
