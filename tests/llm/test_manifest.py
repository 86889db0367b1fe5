import hashlib
import zlib

import pytest

from blockflow.llm.merkle import append_log, completed, fold, manifest, position, proofs, siblings


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"],
              None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """Every level of every tree as lists, proofs by looking aside."""
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        built[name] = levels_of([leaf_of(r) for r in trees[name]])
    top = levels_of([built[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(trees[name]):
            way = [(i >> n, lv) for n, lv in enumerate(built[name][:-1])]
            way += [(k >> n, lv) for n, lv in enumerate(top[:-1])]
            bad = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node, proof = leaf_of(row, bad), ""
            for at, lv in way:
                pair = lv[at - at % 2:at - at % 2 + 2]
                proof += "".join(x for j, x in enumerate(pair) if j != at % 2)
                pair[at % 2] = node
                node = h(*pair)
            out.append((row["doc_id"], built[name][0][i], built[name][-1][0], top[-1][0], h(proof),
                        node, node == top[-1][0]))
    return sorted(out, key=repr)


def test_positions_of_completed_nodes():
    for n in range(1, 40):
        leaves = [str(i) for i in range(n)]
        height = (n - 1).bit_length()
        log, lists = completed(leaves, height), levels_of(leaves)
        assert len(log) == sum(map(len, lists))
        assert all(log[position(k, i, n)] == node for k, level in enumerate(lists)
                   for i, node in enumerate(level))
        assert all(fold(x, way) == lists[-1][0]
                   for x, way in zip(leaves, siblings(log, n, height), strict=True))


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_manifest_against_brute_force(spark, small, edge_docs, bits):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    odd = spark.createDataFrame([(900, "ä", None, None, 3), (None, None, None, None, None),
                                 (7, "x", "", "s", 1), (7, "x", "", "s", 1), (7, "y", "", "s", 1),
                                 (903, "z", "ünder", "s", 2**63 - 1)],
                                docs.select(*names).schema)
    rows = docs.select(*names).limit(60).union(odd).union(edge_docs.select(*names))
    mine = [tuple(r) for r in proofs(manifest(rows, bits)[1], bits).collect()]
    assert sorted(mine, key=repr) == brute([r.asDict() for r in rows.collect()])


def test_log_is_whole_and_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    levels, _ = manifest(docs, 2)
    log = {}
    for r in append_log(levels, 2).collect():
        log.setdefault(r["tree"], {})[r["position"]] = r["digest"]
    trees = {}
    for r in docs.collect():
        trees.setdefault(":" + r["lang"], []).append(r.asDict())
    assert log.keys() == trees.keys()
    for tree, rows in trees.items():
        leaves = [leaf_of(r) for r in sorted(rows, key=lambda r: r["doc_id"])]
        expected = completed(leaves, (len(leaves) - 1).bit_length())
        assert [log[tree][i] for i in range(len(log[tree]))] == expected


def test_no_documents(no_docs):
    assert proofs(manifest(no_docs)[1]).collect() == []
