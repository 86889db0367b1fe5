"""Small helpers that the corpus operators share."""

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs without a blank; these six characters are the blanks.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once per row, also when lambdas inside need it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def crc_remainder(doc_id: int, by: int) -> int:
    """The same for one id inside a task."""
    return zlib.crc32(str(doc_id).encode()) % by


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most that many bytes of text (or one row), so that what a
    task makes of a part stays small whatever the batch holds."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = total = 0
        for row, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(first, row - first)
                first, total = row, 0
            total += n
        if first < len(sizes):
            yield batch.slice(first)


class Memo:
    """What was made of short strings before: at most ``most`` results, emptied when full.

    Results for strings over ``longest`` characters are made each time.
    """

    def __init__(self, most: int = 600_000, longest: int = 128):
        self.made: dict[str, bytes] = {}
        self.most, self.longest = most, longest

    def each(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The results for the keys; ``make`` gets those that are not there yet."""
        made = self.made
        if not (new := [k for k in set(keys) if k not in made]):
            return [made[k] for k in keys]
        if made and len(made) + len(new) > self.most:
            made.clear()
            new = list(set(keys))
        made.update(zip(new, make(new), strict=True))
        found = [made[k] for k in keys]
        if len(made) > self.most:
            made.clear()
        else:
            for k in new:
                if len(k) > self.longest:
                    del made[k]
        return found

    def join(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> bytes:
        """The results for the keys, joined."""
        return b"".join(self.each(keys, make))
