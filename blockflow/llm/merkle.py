"""Merkle manifest of a table, kept as a log of nodes in the order of their completion.

Rows become leaves, and the leaves of a language, by id, a tree. Builders own aligned blocks of
1,024 leaves: a block's nodes do not depend on other blocks, so a builder writes them as soon as
they are complete, children before parents, as one segment of the log. The tops of the blocks are the
leaves of the next builders, until each tree has one node; the tops of all trees form one tree more.
Where a node stands in its segment follows from the sizes of the subtrees before it and of its own,
so siblings are read by position and no node carries its address.

Places of leaves come from a range partitioning by language, id and leaf: each task numbers what it
has, and totals of earlier tasks (a row per task and language) lift the numbers. A language of any
size is many blocks. Segments go to proofs joined with the path above their block, one row per block.

Defined results: a null field is ``-``; a null language is a tree of its own and the first, null ids
come first in their tree; rows with one id are ordered by their leaf, equal rows are leaves each; a null
id is not tampered with, nor is a null n_chars; extra columns are not read; an empty table gives an
empty result. Long texts only pass through the hash function.
"""

from collections.abc import Iterator
from functools import partial, reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockflow.llm.common import remainder, table
from blockflow.session import checkpointed

BITS = 10  # a block has at most 2 ** BITS leaves
TAMPERED = 7


def digest(text: str) -> str:
    """Lowercase hex sha256."""
    return sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The digest of a row: each field as byte count, colon and value, or a dash."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text),
                          F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def completed(leaves: list[str], levels: int) -> list[str]:
    """The nodes over neighbouring leaves, up to ``levels`` above them, in order of completion."""
    log, left = [], {}
    for i, node in enumerate(leaves):
        level = 0
        log.append(node)
        while level < levels and i >> level & 1:
            node = digest(left.pop(level) + node)
            level += 1
            log.append(node)
        left[level] = node
    late = None  # a node that only the end of the leaves completed
    for level in range(levels):
        if (len(leaves) - 1) >> level & 1:
            late = late and digest(left[level] + late)
        else:
            late = digest(late or left[level])
        if late:
            log.append(late)
    return log


def position(level: int, index: int, leaves: int) -> int:
    """Where a node stands among the completed ones: after all nodes of the full subtrees to the
    left of it, and last in its own subtree."""
    first = index << level
    own = min(1 << level, leaves - first)
    size = sum((own + (1 << k) - 1) >> k for k in range(level + 1))
    return 2 * first - first.bit_count() + size - 1


def siblings(log: list[str], leaves: int, levels: int) -> list[list[str]]:
    """For each leaf of a segment the way up: ``<`` and a node to the left, ``>`` and a node to the
    right, or ``=`` where there is no other."""
    rows = [[log[position(level, i, leaves)] for i in range((leaves + (1 << level) - 1) >> level)]
            for level in range(levels)]

    def step(level: int, i: int) -> str:
        if i & 1:
            return "<" + rows[level][i - 1]
        return ">" + rows[level][i + 1] if i + 1 < len(rows[level]) else "="

    return [[step(level, i >> level) for level in range(levels)] for i in range(leaves)]


def fold(node: str, path: list[str]) -> str:
    """The root that a leaf and its way up lead to."""
    for step in path:
        other = step[1:]
        node = digest(other + node if step[0] == "<" else node + other)
    return node


def _height(nodes: int, bits: int) -> int:
    return min(bits, (nodes - 1).bit_length())


def numbered(leaves: DataFrame) -> DataFrame:
    """Leaves (tree, id, leaf, tag, tampered) of a written table with their place in their tree and
    the tree's number of leaves."""
    order = ["tree", "id", "leaf", "tag"]
    rows = checkpointed(leaves.repartitionByRange(*order).sortWithinPartitions(*order)
                        .withColumn("at", F.monotonically_increasing_id())
                        .withColumn("part", F.shiftright("at", 33)))
    parts = rows.groupBy("tree", "part").agg(F.min("at").alias("first"),
                                             F.count("*").alias("here"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "part", "first", F.sum("here").over(whole).alias("n"),
                         F.coalesce(F.sum("here").over(before), F.lit(0)).alias("earlier"))
    return rows.join(parts, ["tree", "part"]).select(
        "tree", "n", (F.col("at") - F.col("first") + F.col("earlier")).alias("place"), "id",
        "leaf", "tampered")


_SEGMENT = ("tree string, n long, block long, ids array<long>, tampered array<string>,"
            " log array<string>, top string")


def _segment(bits: int, key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    n = rows.column("n")[0].as_py()
    log = completed(rows.column("leaf").to_pylist(), _height(n, bits))
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("block", pa.int64()),
                        ("ids", pa.list_(pa.int64())), ("tampered", pa.list_(pa.string())),
                        ("log", pa.list_(pa.string())), ("top", pa.string())])
    return pa.Table.from_pylist([{
        "tree": key[0].as_py(), "n": n, "block": key[1].as_py(),
        "ids": rows.column("id").to_pylist(),
        "tampered": rows.column("tampered").to_pylist(), "log": log, "top": log[-1]}], schema)


def segments(leaves: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """The log of all trees: first the segments over the leaves, then those over the tops of the
    segments before, until each tree has one top."""
    found, rows = [], leaves
    while True:
        found.append(checkpointed(rows.withColumn("block", F.shiftright("place", bits))
                                  .groupBy("tree", "block")
                                  .applyInArrow(lambda key, group: _segment(bits, key, group), _SEGMENT)))
        open_trees = found[-1].filter(F.col("n") > 1 << bits)
        if open_trees.isEmpty():
            return found
        rows = open_trees.select(
            "tree", F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"),
            F.col("block").alias("place"), F.lit(None).cast("long").alias("id"),
            F.col("top").alias("leaf"), F.lit(None).cast("string").alias("tampered"))


def _log_rows(bits: int, level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            first = row["block"] << bits
            here = min(1 << bits, row["n"] - first)
            nodes = [(h, i) for h in range(bool(level), _height(row["n"], bits) + 1)
                     for i in range((here + (1 << h) - 1) >> h)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * len(nodes), pa.string()),
                 pa.array([position(level * bits + h, (first >> h) + i, row["leaves"])
                           for h, i in nodes], pa.int64()),
                 pa.array([row["log"][position(h, i, here)] for h, i in nodes], pa.string())],
                ["tree", "position", "digest"])


def append_log(levels: list[DataFrame], bits: int = BITS) -> DataFrame:
    """The log node by node: tree, position among the tree's nodes in order of completion, digest."""
    sizes = levels[0].groupBy("tree").agg(F.max("n").alias("leaves"))
    return reduce(DataFrame.union, [
        rows.select("tree", "n", "block", "log").join(sizes, "tree").mapInArrow(
            partial(_log_rows, bits, level), "tree string, position long, digest string")
        for level, rows in enumerate(levels)])


def _leaf_ways(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way from each leaf of a segment, whose top's way is ``path``."""
    for batch in batches:
        for row in batch.to_pylist():
            n, first = row["n"], row["block"] << bits
            here = min(1 << bits, n - first)
            ways = [s + row["path"] for s in siblings(row["log"], here, _height(n, bits))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * here), pa.array(range(first, first + here)),
                 pa.array(ways, pa.list_(pa.string()))], ["tree", "block", "above"])


def leaf_ways(rows: DataFrame, bits: int) -> DataFrame:
    """(tree, block, above): a leaf of an upper segment is the top of a block below."""
    return rows.select("tree", "n", "block", "log", "path").mapInArrow(
        partial(_leaf_ways, bits), "tree string, block long, above array<string>")


def ways_up(levels: list[DataFrame], trees: DataFrame, bits: int = BITS) -> DataFrame:
    """The lowest segments with ``path``, the way up from their top; ``trees`` has the way up from
    the one node that is left of each tree, and may have more columns."""
    rows = levels[-1].join(trees, "tree")
    for lower in reversed(levels[:-1]):
        rows = lower.join(trees, "tree").join(leaf_ways(rows, bits), ["tree", "block"],
                                             "left").withColumn(
            "path", F.coalesce("above", "path")).drop("above")
    return rows


def last_nodes(levels: list[DataFrame], bits: int = BITS) -> DataFrame:
    """The one node that is left of each tree."""
    done = [rows.filter(F.col("n") <= 1 << bits).select("tree", "top") for rows in levels]
    return reduce(DataFrame.union, done)


_PROOF = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string,"
          " folded_root string, verified boolean")


def _proofs(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _PROOF.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            n, ids, log = row["n"], row["ids"], row["log"]
            out = {c: [] for c in names}
            for i, (way, bad) in enumerate(zip(siblings(log, len(ids), _height(n, bits)),
                                               row["tampered"], strict=True)):
                path = way + row["path"]
                own = log[position(0, i, len(ids))]
                folded = fold(bad or own, path)
                for c, v in zip(names, (ids[i], own, row["subroot"], row["root"],
                                        digest("".join(s[1:] for s in path)), folded,
                                        folded == row["root"]), strict=True):
                    out[c].append(v)
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c], k) for c, k in zip(names, kinds, strict=True)], names)


def manifest(docs: DataFrame, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """The segments of the trees of all languages, and the lowest of them with subroot, root and
    path, the way from their top to the root."""
    d = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    more = d | {"n_chars": d["n_chars"].cast("decimal(20,0)") + 1}
    leaves = checkpointed(docs.select(
        F.coalesce(F.concat(F.lit(":"), d["lang"].cast("string")), F.lit("-")).alias("tree"),
        d["doc_id"].cast("long").alias("id"), leaf(*d.values()).alias("leaf"),
        F.when((remainder(d["doc_id"], TAMPERED) == 0) & d["n_chars"].isNotNull(),
               leaf(*more.values())).alias("tampered"),
        F.monotonically_increasing_id().alias("tag")))
    levels = segments(numbered(leaves), bits)
    none = F.lit(None).cast("string")
    names = checkpointed(numbered(checkpointed(last_nodes(levels, bits).select(
        F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("top").alias("leaf"),
        F.lit(0).alias("tag"), none.alias("tampered")))))
    over = segments(names.withColumn("id", F.lit(None).cast("long")), bits)
    start = last_nodes(over, bits).withColumn("path", F.array().cast("array<string>"))
    trees = checkpointed(
        names.withColumnRenamed("place", "block").join(leaf_ways(ways_up(over, start, bits), bits),
                                                       ["tree", "block"])
        .join(last_nodes(over, bits).withColumnRenamed("top", "root"), "tree")
        .select(F.col("id").alias("tree"), F.col("leaf").alias("subroot"), "root",
                F.col("above").alias("path")))
    return levels, ways_up(levels, trees, bits)


def proofs(lowest: DataFrame, bits: int = BITS) -> DataFrame:
    """A row per leaf with its proof, from the segments of ``manifest``."""
    return lowest.select("n", "ids", "tampered", "log", "subroot", "root", "path").mapInArrow(
        partial(_proofs, bits), _PROOF)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and checked proof of every document."""
    return proofs(manifest(table(spark, sf_dir, "documents"))[1])


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": """
    with recursive fields as (
        select *, row_number() over () as r, cast(doc_id as varchar) as i,
               cast(n_chars as varchar) as n, cast(n_chars::hugeint + 1 as varchar) as m
        from documents),
    written as (
        select r, doc_id, i, case when lang is null then '-' else ':' || lang end as tree,
               coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') as a,
               coalesce(strlen(n) || ':' || n, '-') as b, coalesce(strlen(m) || ':' || m, '-') as c,
               coalesce(strlen(text) || ':' || text, '-') as d
        from fields),
    polynomials as (
        select list(list_reduce(list_prepend(v, range(8)), lambda x, k:
                    case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)
                    order by v) as t
        from range(256) as g(v)),
    hashed as (
        select r, doc_id, tree, sha256(a || b || d) as leaf, sha256(a || c || d) as other,
               xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
                   string_split(i, ''), lambda x: cast(ascii(x) as bigint))), lambda h, x:
                   xor(h >> 8, t[(xor(h, x) & 255) + 1]))) as crc
        from written, polynomials),
    leaves as (
        select *, coalesce(crc % 7 = 0, false) as tampered,
               row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as p,
               count(*) over (partition by tree) as n
        from hashed),
    nodes(tree, level, idx, digest, n) as (
        select tree, 0, p, leaf, n from leaves
        union all
        select tree, level + 1, idx // 2, sha256(string_agg(digest, '' order by idx)), (n + 1) // 2
        from nodes where n > 1 group by tree, level, idx // 2, n),
    roots as (
        select tree, digest, row_number() over (order by tree) - 1 as p, count(*) over () as n
        from nodes where n = 1),
    upper(level, idx, digest, n) as (
        select 0, p, digest, n from roots
        union all
        select level + 1, idx // 2, sha256(string_agg(digest, '' order by idx)), (n + 1) // 2
        from upper where n > 1 group by level, idx // 2, n),
    steps as (
        select l.r, x.level, l.p >> x.level as own, s.digest
        from leaves l join (select distinct tree, level from nodes where n > 1) x using (tree)
        left join nodes s on s.tree = l.tree and s.level = x.level
            and s.idx = xor(l.p >> x.level, 1)
        union all
        select l.r, 100 + x.level, t.p >> x.level, s.digest
        from leaves l join roots t using (tree)
        cross join (select distinct level from upper where n > 1) x
        left join upper s on s.level = x.level and s.idx = xor(t.p >> x.level, 1)),
    ways as (
        select r, list(case when digest is null then '=' when own & 1 = 1 then '<' || digest
                       else '>' || digest end order by level) as way,
               coalesce(string_agg(digest, '' order by level), '') as siblings
        from steps group by r),
    folded as (
        select l.*, coalesce(w.siblings, '') as siblings, list_reduce(list_prepend(
            case when tampered then other else leaf end, coalesce(w.way, [])), lambda x, s:
            sha256(case when s[1] = '<' then s[2:] || x else x || s[2:] end)) as folded_root
        from leaves l left join ways w using (r))
    select f.doc_id, f.leaf, t.digest as subroot, u.digest as root,
           sha256(f.siblings) as proof_sha256, f.folded_root, f.folded_root = u.digest as verified
    from folded f join roots t using (tree) cross join (select digest from upper where n = 1) u"""}
