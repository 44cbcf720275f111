import hashlib
import zlib

from ledgerline.llm.merkle import folded, manifest, proofs, verify
from pyspark.sql import functions as F

from tests.llm.cases import as_rows, documents, edge_docs, no_docs


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes, fanout, paths):
    """Digest of the top of (digest, leaves) nodes; adds to each leaf's path what stands before and after."""
    while len(nodes) > 1:
        above = []
        for first in range(0, len(nodes), fanout):
            run = nodes[first : first + fanout]
            for k, (_, leaves) in enumerate(run):
                step = tuple("".join(d for d, _ in part) for part in (run[:k], run[k + 1 :]))
                for leaf in leaves:
                    paths[leaf].append(step)
            above.append((digest("".join(d for d, _ in run)), [leaf for _, leaves in run for leaf in leaves]))
        nodes = above
    return nodes[0][0]


def plain(rows, fanout=8):
    trees = {}
    for number, row in enumerate(rows):
        leaf = plain_leaf(row, row["text"])
        trees.setdefault(row["lang"], []).append(((row["doc_id"] is not None, row["doc_id"] or 0), leaf, number))
    paths, subroots, tops = {k: [] for k in range(len(rows))}, {}, []
    for lang in sorted(trees, key=lambda name: (name is not None, (name or "").encode())):
        own = sorted(trees[lang])
        subroot = climbed([(leaf, [number]) for _, leaf, number in own], fanout, paths)
        subroots |= {number: subroot for _, _, number in own}
        tops.append((subroot, [number for _, _, number in own]))
    root = climbed(tops, fanout, paths) if tops else None
    out = []
    for number, row in enumerate(rows):
        own = leaf = plain_leaf(row, row["text"])
        if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
            own = plain_leaf(row, "".join(c.lower() if c.isascii() else c for c in row["text"]))
        for before, after in paths[number]:
            own = digest(before + own + after)
        proof = digest("".join(before + after for before, after in paths[number]))
        out.append((row["doc_id"], leaf, subroots[number], root, proof, own, own == root))
    return sorted(out, key=repr)


def test_documents(spark):
    docs = documents(spark)
    expected = plain([r.asDict() for r in docs.collect()])
    assert as_rows(verify(manifest(docs.repartition(7)))) == expected
    assert {row[-1] for row in expected} == {True, False}


def test_awkward_and_repeated_rows(spark):
    docs = edge_docs(spark).union(edge_docs(spark).where("doc_id = 2 or doc_id is null"))
    assert as_rows(verify(manifest(docs))) == plain([r.asDict() for r in docs.collect()])
    many = spark.createDataFrame([(5, "Same", "en", "a", 4)] * 300 + [(6, "Same", "fr", "a", 4)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    many = many.repartition(6)
    assert as_rows(verify(manifest(many))) == plain([r.asDict() for r in many.collect()])


def test_few_leaves(spark):
    assert verify(manifest(no_docs(spark))).collect() == []
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    one = spark.createDataFrame([(1, "Text", None, None, None)], names)
    found = verify(manifest(one)).collect()
    assert as_rows(verify(manifest(one))) == plain([r.asDict() for r in one.collect()])
    assert found[0].leaf == found[0].subroot == found[0].root


def test_many_trees_and_other_fanouts(spark):
    """Trees of trees: paths of other widths lead each leaf to the one root."""
    rows = spark.range(70).select(
        F.when(F.col("id") % 11 > 0, (F.col("id") % 11).cast("string")).alias("tree"),
        F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"),
        F.col("id").alias("order"),
    )
    found = proofs(rows, ["order"], fanout=3).select("root", folded(F.col("row.leaf"), F.col("path")).alias("again")).collect()
    assert len(found) == 70
    assert len({bytes(r.root) for r in found}) == 1
    assert all(r.again == bytes(r.root).hex() for r in found)
