"""Languages of texts as mixtures: how much of a text is in which language.

Every letter of a text counts twice, alone and between its neighbours (a letter, or the edge of a
word), lower-cased and hashed into a fixed number of cells for each of the two. Training counts the
cells by language; a language's distribution is its relative counts with a small part of the
distribution of all languages together, so that a cell no language knows speaks for none of them.

A text is a mixture of languages. Expectation-maximisation finds the shares of a set of languages;
the set grows from the likeliest single language by the one that promises most, for as long as the
log-likelihood gains more than a penalty of the logarithm of the text's length. The likelihood is
concave in the shares, so its slope towards a language bounds what that language can ever gain:
where no slope exceeds the penalty the set is settled without a further round. The prediction is the
language with the largest share, the score this share times the posterior of its language against
those outside the set.

The model has one number per language and cell: languages are codes, at most ``MOST_LANGUAGES``
(checked), so what the driver gathers and broadcasts is bounded at any size of input.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text if
nothing was learned; a null language is not learned; a null id is not held out; repeated rows are
learned and judged each for themselves; of equally good languages the one first in byte order is
taken; extra columns are not read; an empty table gives an empty result. A text of any length has at
most ``CELLS`` different cells.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.llm.common import remainder, slices, table

FOLDS, LEFT_OUT = 4, 2
ALONE, BETWEEN = 1 << 14, 1 << 16  # cells of letters alone and of letters between neighbours
CELLS = ALONE + BETWEEN
MOST_LANGUAGES = 256
COMMON = 0.05  # part of the common distribution in each language's
SHARED = 4.0  # counts in which one letter takes part: they are not independent
ROUNDS = 25
UNKNOWN = "und"


@cache
def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 where it is none."""
    found = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        if (c := chr(code)).isalpha():
            low = c.lower()
            found[code] = ord(low) if len(low) == 1 else code
    return found


def cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and cell of everything counted in the texts, in the order of the texts."""
    raw = ("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass")
    codes = _lower_letters()[np.frombuffer(raw, np.uint32)]
    letter = codes > 0
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of what stands between words one place is left
    kept[:-1] |= letter[1:] & ~letter[:-1]
    number = np.repeat(np.arange(len(texts), dtype=np.int32),
                       np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    number = np.append(number[:1], number)[kept]
    codes = codes[kept].astype(np.uint64)
    at = np.flatnonzero(codes)
    one = codes[at] * np.uint64(0x9E3779B97F4A7C15)
    near = (codes[at - 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ one
            ^ codes[at + 1] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    alone = (one >> np.uint64(64 - 14)).astype(np.int32)
    between = (near >> np.uint64(64 - 16)).astype(np.int32) + ALONE
    return np.repeat(number[at], 2), np.column_stack((alone, between)).ravel()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * max(len(at), 1)), pa.array(at if len(at) else [0], pa.int32()),
                 pa.array(n[at] if len(at) else [0], pa.int64())], ["lang", "cell", "n"])
        held.clear()

    for batch in batches:
        for part in slices(iter([batch])):
            texts = [t or "" for t in part.column("text").to_pylist()]
            langs = part.column("lang").to_pylist()
            number, cell = cells(texts)
            here = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
            own = np.array([here[lang] for lang in langs], dtype=np.int64)[number]
            for lang, i in here.items():
                n = np.bincount(cell[own == i] if len(here) > 1 else cell, minlength=CELLS)
                held[lang] = held[lang] + n if lang in held else n
            if len(held) > 64:
                yield from flush()
    yield from flush()


@dataclass
class Profiles:
    """Languages in byte order and, for each, the probability of every cell."""

    languages: list[str]
    chance: np.ndarray


def learn(labelled: DataFrame) -> Profiles:
    """The profiles of rows (lang, text) whose lang is not null."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"),
                           F.col("text").cast("string").alias("text")).filter("lang is not null")
    counts = rows.mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(
        F.sum("n").alias("n"))
    # At most MOST_LANGUAGES * CELLS rows, and a few more if there are too many languages.
    found = counts.limit(MOST_LANGUAGES * CELLS + 1).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode()
    languages = names.dictionary.to_pylist() if len(found) else []
    if len(languages) > MOST_LANGUAGES or len(found) > MOST_LANGUAGES * CELLS:
        raise ValueError(f"more than {MOST_LANGUAGES} different values of lang: these are no"
                         " language codes")
    n = np.zeros((len(languages), CELLS))
    if len(found):
        n[names.indices.to_numpy(), found.column("cell").to_numpy()] = found.column("n").to_numpy()
    order = sorted(range(len(languages)), key=lambda i: languages[i].encode())
    n = n[order]
    chance = np.empty(n.shape, dtype=np.float32)
    for part in (slice(0, ALONE), slice(ALONE, CELLS)):
        every = n[:, part].sum(axis=0) + 0.5
        common = every / every.sum()
        own = n[:, part] / np.maximum(n[:, part].sum(axis=1, keepdims=True), 1)
        chance[:, part] = (1 - COMMON) * own + COMMON * common
    return Profiles([languages[i] for i in order], chance)


class Mixtures:
    """The mixtures of some texts, given by how often (n) which cell stands in which text."""

    def __init__(self, chance: np.ndarray, text: np.ndarray, cell: np.ndarray, n: np.ndarray,
                 texts: int):
        self.chance, self.text, self.cell, self.n, self.texts = chance, text, cell, n, texts
        self.size = np.bincount(text, n, texts)
        self.penalty = 0.5 * SHARED * np.log1p(self.size)
        languages = len(chance)
        self.single = np.stack([np.bincount(text, n * np.log(chance[k][cell]), texts)
                                for k in range(languages)], axis=1)
        best = self.single.argmax(axis=1)
        self.members = np.zeros((texts, languages), dtype=bool)
        self.members[np.arange(texts), best] = True
        self.shares = self.members.astype(float)
        self.likelihood = self.single.max(axis=1, initial=-np.inf)
        self._grow()

    def _mixed(self, shares: np.ndarray, text: np.ndarray, cell: np.ndarray) -> np.ndarray:
        mixed = np.zeros(len(cell))
        for k in np.flatnonzero(shares.any(axis=0)):
            mixed += shares[text, k] * self.chance[k][cell]
        return mixed

    def _slopes(self, shares: np.ndarray, text: np.ndarray, cell: np.ndarray, n: np.ndarray,
                which: np.ndarray) -> np.ndarray:
        """Per text and language of ``which``, the sum of n times chance over mixture."""
        weight = n / self._mixed(shares, text, cell)
        out = np.zeros(shares.shape)
        for k in np.flatnonzero(which):
            out[:, k] = np.bincount(text, weight * self.chance[k][cell], len(shares))
        return out

    def _grow(self) -> None:
        languages = len(self.chance)
        tried = self.members.copy()
        texts = np.arange(self.texts)  # those whose set is not settled
        text, cell, n = self.text, self.cell, self.n
        while len(texts):
            shares = self.shares[texts]
            slopes = self._slopes(shares, text, cell, n, np.ones(languages, dtype=bool))
            gain = np.where(tried[texts], -np.inf, slopes - self.size[texts, None])
            other = gain.argmax(axis=1)
            on = gain.max(axis=1) > self.penalty[texts]
            if not on.any():
                return
            # From here on with the rows of the texts that may gain.
            rows = on[text]
            renumber = np.cumsum(on) - 1
            text, cell, n = renumber[text[rows]], cell[rows], n[rows]
            texts, shares, other = texts[on], shares[on], other[on]
            every = np.arange(len(texts))
            tried[texts, other] = True
            shares = 0.8 * shares
            shares[every, other] += 0.2
            for _ in range(ROUNDS):
                shares *= self._slopes(shares, text, cell, n, shares.any(axis=0))
                shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-300)
            reached = np.bincount(text, n * np.log(self._mixed(shares, text, cell)), len(texts))
            taken = reached - self.likelihood[texts] > self.penalty[texts]
            won = texts[taken]
            self.shares[won], self.likelihood[won] = shares[taken], reached[taken]
            self.members[won, other[taken]] = True

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """The language with the largest share of each text, and its score."""
        best = self.shares.argmax(axis=1)
        at = np.arange(self.texts)
        ahead = (self.single - self.single[at, best][:, None]) / SHARED
        rivals = np.where(self.members, 0.0, np.exp(np.minimum(ahead, 500.0))).sum(axis=1)
        return best, np.clip(self.shares[at, best], 0.0, 1.0) / (1.0 + rivals)


_RESULT = ("doc_id long, held_out boolean, lang_pred string, score double, langs array<string>,"
           " shares array<double>")


def _judge(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    profiles: Profiles = shared.value
    languages = np.array([*profiles.languages, UNKNOWN], dtype=object)
    names = [f.split()[0] for f in _RESULT.split(", ")]
    most = max(100_000, 4_000_000 // max(len(profiles.languages), 4))
    for part in slices(batches, most=most):
        texts = [t or "" for t in part.column("text").to_pylist()]
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        langs, shares = [[]] * len(texts), [[]] * len(texts)
        number, cell = cells(texts)
        if len(number) and profiles.languages:
            pairs, n = np.unique(number.astype(np.int64) << 17 | cell, return_counts=True)
            lettered, text = np.unique(pairs >> 17, return_inverse=True)
            found = Mixtures(profiles.chance, text, pairs & 0x1FFFF, n.astype(float), len(lettered))
            best[lettered], score[lettered] = found.scores()
            for i, row, members in zip(lettered.tolist(), found.shares, found.members,
                                       strict=True):
                order = [k for k in np.argsort(-row, kind="stable") if members[k]]
                langs[i] = languages[order].tolist()
                shares[i] = row[order].tolist()
        columns = [part.column("doc_id"), part.column("held_out"),
                   pa.array(languages[best].tolist(), pa.string()), pa.array(score),
                   pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The predicted language of every document, and the languages of its set with their shares."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"),
        F.col("text").cast("string").alias("text")).mapInArrow(partial(_judge, shared), _RESULT)


def _held_out():
    return F.coalesce(remainder(F.col("doc_id"), FOLDS) == LEFT_OUT, F.lit(False))


def op13_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs.filter(~_held_out())))


QUERIES = {"op13_language_mixture": op13_language_mixture}
ORACLES: dict[str, str] = {}
