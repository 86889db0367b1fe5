"""Edit distance of texts and what deletions leave of words, a batch of rows at a time.

Spark's own ``levenshtein`` fills a table of length times length for each pair. Here most pairs of two
readings of a line need none: their distance is at least the difference of their letter counts
and at most the places in which they differ, and where both are the same number, that is it. The
others go through the table column by column, packed into bits, all rows of a batch at once.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 256    # characters of texts that are compared as rows of a matrix
CELLS = 1 << 20  # characters in one matrix
LETTERS = 512    # codes that are counted for the lower bound


def edits_of(a: str, b: str) -> int:
    """Edit distance, one column of the table per step packed into an integer."""
    if not a or not b:
        return len(a) or len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        equal = places.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal
        more = down | (full & ~(diagonal | up))
        less = up & diagonal
        distance += bool(more & high) - bool(less & high)
        more, less = (more << 1) | 1, less << 1
        side = equal | down
        up, down = (less | ~(side | more)) & full, more & side & full
    return distance


def _matrix(texts: list[str], sizes: np.ndarray, width: int) -> np.ndarray:
    """Code points, a row per text."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    top = flat.max(initial=0)
    out = np.zeros((len(texts), width), np.uint8 if top < 1 << 8 else np.uint32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _bounds(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """What the distance is at least and at most."""
    width = a.shape[1]
    both = np.arange(width) < np.minimum(na, nb)[:, None]
    most = ((a != b) & both).sum(axis=1) + abs(na - nb)
    letters = int(max(a.max(initial=0), b.max(initial=0))) + 1
    if letters > LETTERS:
        return abs(na - nb), most
    rows = np.arange(len(a))[:, None] * letters

    def counts(m: np.ndarray) -> np.ndarray:  # padding counts as letter 0, which is put right below
        return np.bincount((rows + m).ravel(), minlength=len(m) * letters).reshape(-1, letters)

    more = counts(a) - counts(b)
    more[:, 0] += na - nb
    return np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1)), most


def _columns(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Distances by columns of bits (Myers, Hyyrö), in words of 64; no text of ``a`` is empty."""
    one, words = np.uint64(1), -(-a.shape[1] // 64)
    padded = np.zeros((len(a), words * 64), a.dtype)
    padded[:, :a.shape[1]] = a
    up = np.full((words, len(a)), ~np.uint64(0))
    down = np.zeros_like(up)
    distance, last, bit = na.copy(), (na - 1) // 64, ((na - 1) % 64).astype(np.uint64)
    for k in range(int(nb.max(initial=0))):
        equal = np.packbits(padded == b[:, k, None], axis=1, bitorder="little").view("<u8")
        more_in, less_in = one, np.uint64(0)
        for w in range(words):
            eq, u, d = equal[:, w], up[w], down[w]
            side = eq | d
            eq = eq | less_in
            diagonal = (((eq & u) + u) ^ u) | eq
            more, less = d | ~(diagonal | u), u & diagonal
            step = ((more >> bit) & one).astype(np.int64) - ((less >> bit) & one).astype(np.int64)
            distance += np.where((last == w) & (k < nb), step, 0)
            more_out, less_out = more >> np.uint64(63), less >> np.uint64(63)
            more, less = (more << one) | more_in, (less << one) | less_in
            up[w], down[w] = less | ~(side | more), more & side
            more_in, less_in = more_out, less_out
    return distance


def _small(a: list[str], b: list[str]) -> np.ndarray:
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    width = int(max(na.max(initial=0), nb.max(initial=0), 1))
    ma, mb = _matrix(a, na, width), _matrix(b, nb, width)
    least, most = _bounds(ma, mb, na, nb)
    most = np.where((na == 0) | (nb == 0), np.maximum(na, nb), most)
    open_ = (least < most) & (na > 0) & (nb > 0)
    if open_.any():
        most[open_] = _columns(ma[open_], mb[open_], na[open_], nb[open_])
    return most


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distance of each pair; pairs of a similar length go together."""
    out = np.zeros(len(a), np.int32)
    sizes = np.fromiter(map(max, map(len, a), map(len, b)), np.int64, len(a))
    order = np.argsort(sizes, kind="stable")
    start, short = 0, int((sizes <= LONGEST).sum())
    while start < short:
        end = min(short, start + CELLS // LONGEST)
        part = order[start:end]
        out[part] = _small([a[k] for k in part], [b[k] for k in part])
        start = end
    for k in order[short:]:
        out[k] = edits_of(a[k], b[k])
    return out


def _batch(a: pa.Array, b: pa.Array) -> pa.Array:
    left, right = a.to_pylist(), b.to_pylist()
    none = np.fromiter((x is None or y is None for x, y in zip(left, right)), bool, len(left))
    found = distances(["" if n else x for n, x in zip(none, left)],
                      ["" if n else y for n, y in zip(none, right)])
    return pa.array(found, pa.int32(), mask=none)


def edits(a: Column, b: Column) -> Column:
    """Edit distance of two text columns, null where either is."""
    return F.arrow_udf(_batch, "int")(a, b)


def _left(word: str, depth: int) -> set[str]:
    out = {word}
    out.update(word[:i] + word[i + 1:] for i in range(len(word)))
    if depth == 2:
        out.update(word[:i] + word[i + 1:j] + word[j + 1:]
                   for i, j in combinations(range(len(word)), 2))
    return out


def _left_once(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else list(_left(w, 1)) for w in words.to_pylist()],
                    pa.list_(pa.string()))


def _left_twice(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else list(_left(w, 2)) for w in words.to_pylist()],
                    pa.list_(pa.string()))


def deletions(c: Column, depth: int) -> Column:
    """A word and all that is left of it after up to ``depth`` (1 or 2) deletions."""
    return F.arrow_udf(_left_once if depth == 1 else _left_twice, "array<string>")(c)
