"""Near-duplicate groups from bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct five-word shingles; its sketch is the
``SKETCH`` smallest of them. Documents with equal sets form a class and only a class's smallest id
goes on. The work then narrows step by step, without giving up a link:

1. Inverted lists of the retained values say how many values of a sketch also stand in another
   one. Sets with a similarity of 0.75 share at least ``OVERLAP`` of 64 values but for a chance of
   about one in ten million, so representatives with fewer shared values are done.
2. For the others the lists are taken over whole sets. A linked pair overlaps in three quarters of
   either set, so it shares one of the rarest quarter of each (plus one), and the places where the
   first shared value stands bound the overlap. Both tests are exact.
3. In each list everyone is held against one hub, the document whose values are the commonest.
   What gets linked falls into components; a second pass only holds documents outside the hub's
   component against the others, so large groups of near copies stay linear.
4. The estimate over the union of both sketches drops most wrong pairs, and the overlap of the whole
   sets decides.

Hot values and groups: counts are combined before the shuffle, and every join that a hot value, hub
or class can hit is between two freshly shuffled sides, which Spark splits where they are skewed.

Defined results: a null text, or one without a word, has an empty set and is alone. Rows under
one id are one document: their texts count as linked. A row without an id gets the component of
its text and is kept only if that has no id at all. Extra columns are not read; an empty table
gives an empty result.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.llm.common import ascii_lower, let, table, words_of
from blockflow.session import checkpointed

SHINGLE = 5
SKETCH, OVERLAP = 64, 29   # Binomial(64, 0.75) is below 29 with a probability of 1e-7
BUCKETS = 1 << 20          # bound of the table that spares most texts a shuffle


def shingle_hashes(text: Column) -> Column:
    """Distinct shingle hashes of a text, in order; with fewer words the whole sequence is one."""
    return let(words_of(ascii_lower(text.cast("string"))), lambda w: F.when(
        F.size(w) == 0, F.array().cast("array<bigint>")).when(
        F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(F.sort_array(F.array_distinct(
            F.transform(F.slice(w, 1, F.size(w) - (SHINGLE - 1)), lambda x, i: F.xxhash64(
                x, *(F.get(w, i + k) for k in range(1, SHINGLE))))))))


def _set_keys(hashes: Column) -> list[Column]:
    return [F.size(hashes).alias("n"), F.xxhash64(hashes).alias("k1"),
            F.xxhash64(F.lit(1), hashes).alias("k2")]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); the root is the smallest node reachable.

    Every node moves to its smallest neighbour and edges are rewritten until none is left; a round
    at least halves the nodes of a component, and the written tables cut the lineage.
    """
    left = checkpointed(edges.filter("a <> b").select("a", "b").distinct())
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = checkpointed(both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("parent")))
        if roots is None:
            roots = parents.withColumnRenamed("parent", "root")
        else:
            step = parents.withColumnRenamed("node", "root")
            roots = checkpointed(roots.join(step, "root", "left").select(
                "node", F.coalesce("parent", "root").alias("root")))
        at_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        at_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = checkpointed(left.join(at_a, "a").join(at_b, "b").filter("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _overlapping(classes: DataFrame) -> DataFrame:
    """Representatives with enough sketch values that stand in another sketch, too."""
    lists = classes.select("rep", "n", "k1", F.explode("sketch").alias("value"))
    shared = checkpointed(lists.groupBy("value").count().filter("count > 1").select("value"))
    found = lists.join(shared, "value").groupBy("rep", "n", "k1").count()
    retained = F.least(F.col("n"), F.lit(SKETCH))
    return found.filter(F.col("count") >= F.greatest(
        F.floor(retained * OVERLAP / SKETCH), F.lit(1))).select("rep", "n", "k1")


def _whole_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """rep, n, sketch, weight and the values that other chosen sets hold too, rarest first."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    buckets = F.broadcast(chosen.select(  # at most BUCKETS rows
        F.pmod(F.xxhash64("rep"), F.lit(BUCKETS)).alias("bucket")).distinct())
    near = docs.withColumn("bucket", bucket).join(buckets, "bucket", "left_semi")
    sets = checkpointed(
        near.join(chosen.withColumnRenamed("rep", "doc_id").withColumnRenamed("k1", "key"),
                  "doc_id")
        .select(F.col("doc_id").alias("rep"), "n", "key", shingle_hashes(F.col("text")).alias("h"))
        .filter((F.size("h") == F.col("n")) & (F.xxhash64("h") == F.col("key")))
        .select("rep", "n", "h"))
    lists = sets.select("rep", "n", F.explode("h").alias("value"))
    counts = checkpointed(lists.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"))
    values = lists.join(counts, "value").groupBy("rep", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"), F.sum("df").alias("s"))
    return checkpointed(values.join(
        sets.select("rep", "n", F.slice("h", 1, SKETCH).alias("sketch")), ["rep", "n"]).select(
        "rep", "n", "sketch", (F.col("s") / F.col("n")).alias("weight"),
        F.col("v")["value"].alias("values")))


def _may_link(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether a pair that first meets at these places can still overlap enough."""
    rest = F.least(a["shared"] - a["pos"], b["shared"] - b["pos"])
    return (a["rep"] != b["rep"]) & (7 * rest >= 3 * (a["n"] + b["n"]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are linked: by the estimate over the union sketch, then by whole sets."""
    def side(x: str) -> DataFrame:
        return sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"),
                           F.col("sketch").alias(f"s_{x}"), F.col("values").alias(f"v_{x}"))

    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, SKETCH)
    both = F.array_intersect(union, F.array_intersect("s_a", "s_b"))
    common = F.size(F.array_intersect("v_a", "v_b"))
    return checkpointed(
        pairs.distinct().join(side("a"), "a").join(side("b"), "b")
        .filter(F.size(both) >= F.greatest(F.floor(F.size(union) * OVERLAP / SKETCH), F.lit(1)))
        .withColumn("common", common)
        .filter(100 * F.col("common") >= 75 * (F.col("n_a") + F.col("n_b") - F.col("common")))
        .select("a", "b").distinct())


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between representatives, enough of them to join what is linked."""
    shared = F.size("values")
    rarest = F.floor(F.col("n") / 4) + 1 - (F.col("n") - shared)
    lists = checkpointed(sets.select(
        "rep", "n", "weight", shared.alias("shared"),
        F.posexplode(F.slice("values", 1, F.greatest(rarest, F.lit(0)).cast("int")))
        .alias("pos", "value")))
    hubs = checkpointed(lists.groupBy("value").agg(
        F.max(F.struct("weight", "rep", "n", "shared", "pos")).alias("hub"),
        F.count("*").alias("size")).filter("size > 1").select("value", "hub"))

    def pair(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    own = {c: F.col(c) for c in ("rep", "n", "shared", "pos")}
    first = _verified(lists.join(hubs, "value").filter(
        _may_link(own, {c: F.col("hub")[c] for c in own}))
        .select(*pair(F.col("rep"), F.col("hub")["rep"])), sets)
    roots = components(first)
    placed = checkpointed(lists.drop("weight").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "root", F.coalesce("root", "rep")))
    hub_roots = hubs.select("value", F.col("hub")["rep"].alias("node")).join(
        roots, "node", "left").select("value", F.coalesce("root", "node").alias("hub_root"))
    outside = checkpointed(placed.join(hub_roots, "value").filter("root <> hub_root").select(
        "value", *(F.col(c).alias(f"o_{c}") for c in [*own, "root"])))
    second = _verified(placed.join(outside, "value").filter(
        (F.col("root") != F.col("o_root"))
        & _may_link(own, {c: F.col(f"o_{c}") for c in own}))
        .select(*pair(F.col("rep"), F.col("o_rep"))), sets)
    return first.unionByName(second)


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = docs.select("doc_id", shingle_hashes(F.col("text")).alias("h"))
    rows = checkpointed(hashed.select("doc_id", F.slice("h", 1, SKETCH).alias("sketch"),
                                      *_set_keys(F.col("h"))))
    classes = checkpointed(rows.filter("n > 0").groupBy("n", "k1", "k2", "sketch").agg(
        F.min("doc_id").alias("rep")))
    named = classes.filter("rep is not null")
    sets = _whole_sets(docs, checkpointed(_overlapping(named)))
    # Texts under one id are linked through that id.
    same_id = rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low <> high").select("doc_id")
    repeated = rows.join(same_id, "doc_id").join(classes, ["n", "k1", "k2"]).select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links(sets).unionByName(repeated))
    placed = checkpointed(classes.select("n", "k1", "k2", F.col("rep").alias("node")).join(
        roots, "node", "left").select("n", "k1", "k2", F.coalesce("root", "node").alias("root")))
    return rows.drop("sketch").join(placed, ["n", "k1", "k2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("root")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"),
                                    F.col("component_id").isNull()))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates among all documents."""
    return near_groups(table(spark, sf_dir, "documents"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: one document of each group stays."""
    lost = checkpointed(near_groups(docs).filter("not kept and doc_id is not null")
                        .select("doc_id").distinct())
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


QUERIES = {"op8_near_duplicates": op8_near_duplicates}
ORACLES: dict[str, str] = {}
