"""Edit distances and stripped texts by the quick ways equal those by the plain ones."""

import random

from pyspark.sql import functions as F

from blockflow.functions import text as tx
from blockflow.functions.edits import distances, edits, edits_of
from blockflow.operators import score as sc


def plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def test_distances_of_a_batch_equal_the_table():
    rng, pairs = random.Random(3), []
    for _ in range(300):
        letters = rng.choice(["ab", "abc de\0", "aé漢😀", "eco"])
        a = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 129, 257]))]
        b = [{"e": "c"}.get(x, x) for x in a]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    got = distances(*map(list, zip(*pairs)))
    assert list(got) == [plain(a, b) for a, b in pairs] == [edits_of(a, b) for a, b in pairs]


def test_error_rate_fills_no_table_per_pair(spark):
    df = spark.createDataFrame([("Café  uno", "cafc uno "), ("", "x"), (None, "x"), ("a", "a")],
                               "ref string, hyp string").coalesce(1)
    rates = sc.error_rate(df)
    assert "levenshtein" not in rates._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.edits, r.cer) for r in rates.collect()] == [
        (1, 0.125), (1, 1.0), (None, None), (0, 0.0)]
    got = df.select(edits(F.col("ref"), F.col("hyp")).alias("n"),
                    F.levenshtein("ref", "hyp").alias("m")).collect()
    assert [r.n for r in got] == [r.m for r in got]


def test_blanks_go_as_by_replacing(spark):
    texts = ["", " ", "a", " a  b\t\nc ", "\n\na\nb  ", "x \u0085", "no  blank", None,
             "   é ", "a\tb", "a \r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    ends = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    got = df.select(tx.strip(F.col("t")).alias("a"), ends.alias("b"),
                    tx.collapse(F.col("t")).alias("c"),
                    F.regexp_replace(ends, r"(?U)\s+", " ").alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)
