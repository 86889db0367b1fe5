"""Quality by a regularised quadratic discriminant over statistics of a document's text.

Twelve statistics of the whole text, as logarithms of smoothed rates, form a vector. For each class
the labelled documents give count, sums and sums of products in one aggregation, so training takes
every labelled row and the driver only sees one row per class. Class covariances are shrunk towards
the pooled one and that towards a multiple of the identity. The score is the logistic of the
difference of the two Gaussian log-densities plus the log of the prior odds, divided by the
number of statistics because they are not independent; Cholesky factors are made once.

Defined results: a null text is an empty one and is scored like any other; repeated rows are scored
each for themselves; a document with several labels is learned once per label, a null label not
at all; a null id is not held out and has no label; extra columns are not read. If a class has
fewer than two labelled documents nothing speaks against a text: every score is 1. An empty table
gives an empty result. Statistics take time linear in the text, so long texts do no harm.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.llm.common import BLANKS, let, remainder, table, words_of
from blockflow.session import checkpointed

STATISTICS = 12
SHRINK_TO_POOLED = 0.1
SHRINK_TO_SPHERE = 0.02
ACCEPT = 0.7  # lowest score of a document that is predicted good


def statistics(text: Column) -> Column:
    """The statistics of a text as an array of doubles."""
    def count(t: Column, characters: str) -> Column:
        return F.length(t) - F.length(F.translate(t, characters, ""))

    def rate(part: Column, whole: Column) -> Column:
        return F.log((part + F.lit(0.5)) / (whole + F.lit(1.0)))

    def figures(t: Column, words: Column, lines: Column) -> Column:
        n, chars = F.size(words), F.length(t)
        capitals = count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return F.array(
            F.log1p(n.cast("double")), rate(F.length(F.translate(t, BLANKS, "")), n),
            rate(count(t, "#*$%&|<>"), n), rate(capitals, chars), rate(count(t, "!?"), n),
            rate(count(t, ".,;:"), n), rate(F.size(F.array_distinct(words)), n),
            rate(F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))), n),
            rate(count(t, "0123456789"), chars), rate(F.size(lines), n),
            F.log1p(F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))
                    .cast("double")),
            rate(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)))

    t = F.coalesce(text.cast("string"), F.lit(""))
    return let(F.struct(t.alias("t"), words_of(t).alias("w"), F.split(t, "\n").alias("l")),
               lambda s: figures(s["t"], s["w"], s["l"]))


@dataclass
class Model:
    """Means, inverse Cholesky factors and constants of class 0 and class 1, standardised."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray


def fit(labelled: DataFrame) -> Model | None:
    """The model of rows with a label (0 or 1) and an array x; None without two rows of each."""
    k = STATISTICS
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(k)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}")
                for i in range(k) for j in range(i, k)]
    rows = {r["label"]: r for r in labelled.filter(F.col("label").isin(0, 1)).groupBy("label")
            .agg(F.count("*").alias("n"), *sums, *products).collect()}
    if any(c not in rows or rows[c]["n"] < 2 for c in (0, 1)):
        return None
    n = np.array([rows[c]["n"] for c in (0, 1)], dtype=float)
    total = np.array([[rows[c][f"s{i}"] for i in range(k)] for c in (0, 1)])
    square = np.array([[[rows[c][f"p{min(i, j)}_{max(i, j)}"] for j in range(k)]
                        for i in range(k)] for c in (0, 1)])
    centre = total.sum(axis=0) / n.sum()
    scatter = square - total[:, :, None] * total[:, None, :] / n[:, None, None]
    pooled = scatter.sum(axis=0) / (n.sum() - 2)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    means = (total / n[:, None] - centre) / scale
    unit = scale[:, None] * scale[None, :]
    pooled = pooled / unit
    factors, constants = [], []
    for c in (0, 1):
        own = scatter[c] / (n[c] - 1) / unit
        own = (1 - SHRINK_TO_POOLED) * own + SHRINK_TO_POOLED * pooled
        own = (1 - SHRINK_TO_SPHERE) * own + SHRINK_TO_SPHERE * np.trace(own) / k * np.eye(k)
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n[c] / n.sum()) - np.log(np.diag(lower)).sum())
    return Model(centre, scale, means, np.array(factors), np.array(constants))


def score(model: Model | None, x: Column) -> Column:
    """The score of an array of statistics."""
    if model is None:
        return F.lit(1.0)

    k = len(model.centre)

    def density(z: Column, c: int) -> Column:
        """Log-density of class c: the squares of the factor's rows times z - mean."""
        offset = model.factors[c] @ model.means[c]
        total = F.lit(float(model.constants[c]))
        for i in range(k):
            row = F.lit(-float(offset[i]))
            for j in range(i + 1):
                row = row + z[j] * float(model.factors[c][i][j])
            total = total - F.lit(0.5) * row * row
        return total

    z = F.array(*((x[i] - float(model.centre[i])) / float(model.scale[i]) for i in range(k)))
    return let(z, lambda v: let(density(v, 1), lambda one: let(
        density(v, 0), lambda zero: F.lit(1.0) / (F.lit(1.0) + F.exp(
            F.greatest(F.lit(-500.0), F.least(F.lit(500.0), (zero - one) / float(k))))))))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, x) that have a label and are not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label")).filter(
        F.col("label").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    return rows.select("doc_id", "x").join(known, "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    rows = checkpointed(docs.select("doc_id", statistics(F.col("text")).alias("x")))
    model = fit(with_labels(rows, table(spark, sf_dir, "labels")))
    return rows.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        score(model, F.col("x")).alias("score")).withColumn(
        "predicted", (F.col("score") >= ACCEPT).cast("int"))


def reject_low(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the documents that the classifier accepts."""
    rows = checkpointed(docs.select("doc_id", statistics(F.col("text")).alias("x")))
    model = fit(with_labels(rows, table(spark, sf_dir, "labels")))
    return docs.filter(let(statistics(F.col("text")), lambda x: score(model, x)) >= ACCEPT)


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
