"""Merkle manifest of a table, with proofs found by pointer jumping.

Each row is a leaf. The leaves of a tree (documents: of a language) stand in
order; every eight consecutive nodes become the hash of their digests, until
one is left, the subroot. The subroots, in order of their trees, become the
root in the same way.

A node holds a pointer to an ancestor and the segment of siblings on the way
there, per level those before and those after. At first that is its parent.
In each round the table of nodes is joined with itself: a node's pointer
moves on to where the ancestor's points, and the ancestor's segment is put
behind its own, so distances double and a proof over 12 levels takes 4
rounds. Leaves come in last, a run of eight siblings in one row, which is
joined to its parent's complete segment once.

Digests are kept as 32 bytes and written as hex where they are hashed. A
row's place in its tree comes from a range partitioning, not from a window
per tree, so one tree may hold all rows. The driver sees the size of the
largest tree and the root.

Defined results: null ids come first, and rows with equal ids are ordered by
leaf; equal rows are leaves of their own, next to each other; a null tree is
a tree and comes first; a tree of one leaf has that leaf as subroot, and a
single subroot is the root; an empty table has no rows; a null id is never
tampered with; other columns are ignored by `manifest`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, ship
from ledgerline.llm.ordering import numbered

FANOUT = 8
_SEGMENT = "array<struct<before:binary,after:binary>>"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hashed(text: Column) -> Column:
    """SHA-256, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a row: of each value `-` if null, else its bytes in UTF-8, `:` and itself."""
    return _hashed(F.concat(*map(_part, (doc_id, source, lang, n_chars, text))))


def _node(tree: Column, level: int, place: Column) -> Column:
    return F.concat(F.lit(f"{level}:"), place.cast("string"), F.lit(":"), tree)


def _runs(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """tree, place, n and digest of the parents of nodes, with their `members` in order.

    `nodes`: tree, place, n (nodes of that tree on this level), digest, own.
    """
    members = F.array_sort(F.collect_list(F.struct("place", "digest", "own")))
    up = F.floor(F.col("place") / fanout)
    runs = nodes.where(F.col("n") > 1).groupBy("tree", up.alias("up")).agg(members.alias("members"), F.max("n").alias("n"))
    text = F.array_join(F.transform("members", lambda m: _hex(m["digest"])), "")
    return cut(
        runs.select(
            "tree",
            F.col("up").cast("bigint").alias("place"),
            F.ceil(F.col("n") / fanout).cast("bigint").alias("n"),
            _hashed(text).alias("digest"),
            _node(F.col("tree"), level + 1, F.col("up")).alias("own"),
            "members",
        )
    )


def _joined(members: Column) -> Column:
    return F.aggregate(members, F.lit(b""), lambda all_, m: F.concat(all_, m["digest"]))


def _siblings(runs: DataFrame) -> DataFrame:
    """A row per member of a run: `member`, `up`, and its `step` to there."""
    members = F.col("members")
    steps = F.transform(
        members,
        lambda m, i: F.struct(
            m.alias("member"),
            F.struct(
                _joined(F.slice(members, F.lit(1), i)).alias("before"),
                _joined(F.slice(members, i + 2, F.size(members))).alias("after"),
            ).alias("step"),
        ),
    )
    return runs.select(F.col("own").alias("up"), F.explode(steps).alias("one")).select("up", "one.member", "one.step")


def _levels(most: int, fanout: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while most > 1:
        most, levels = -(-most // fanout), levels + 1
    return levels


def _climbed(nodes: DataFrame, levels: int, first: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Per level the steps (own, digest, up, step) of its nodes that have a parent; the nodes that have none.

    `first`: the level of the given nodes.
    """
    steps, tops = [], nodes.where(F.col("n") == 1).select("tree", "digest", "own")
    for level in range(first, first + levels):
        runs = _runs(nodes, level, fanout)
        steps.append(_siblings(runs).select("member.own", "member.digest", "up", "step"))
        nodes = runs.drop("members")
        tops = tops.union(nodes.where(F.col("n") == 1).select("tree", "digest", "own"))
    return steps, tops


def jumped(nodes: DataFrame, root: str, depth: int) -> DataFrame:
    """own, segment (all the way to the root) and subroot of each node below the root.

    `nodes`: own, up, segment (to `up`) and subroot (null where it is not known yet).
    """
    nodes, reach = cut(nodes), 1
    while reach < depth:
        further = nodes.toDF("met", "next", "more", "met_subroot")
        waiting = nodes.where(F.col("up") != root).join(further, F.col("up") == F.col("met"))
        moved = waiting.select(
            "own",
            F.col("next").alias("up"),
            F.concat("segment", "more").alias("segment"),
            F.coalesce("subroot", "met_subroot").alias("subroot"),
        )
        nodes = cut(moved.union(nodes.where(F.col("up") == root)))
        reach *= 2
    return nodes.drop("up")


def proofs(rows: DataFrame, order: list[str], fanout: int = FANOUT) -> DataFrame:
    """`row` of each leaf, with `subroot`, `root` (bytes) and `path`, its siblings up to the root.

    `rows`: tree (string, may be null), leaf (32 bytes), and the columns of
    `order`; leaves of equal order stand in order of their digests.
    """
    ship(rows.sparkSession)
    # Trees sort by their key, null first; the key of the tree of subroots is empty.
    key = F.when(F.col("tree").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("tree")))
    by = [*order, "leaf"]
    keyed = rows.select(key.alias("key"), F.struct("*").alias("row"), *(F.col(c).alias(f"by_{c}") for c in by))
    leaves = numbered(keyed, "key", [f"by_{c}" for c in by], ["row"]).select(
        F.col("key").alias("tree"),
        F.col("number").alias("place"),
        F.col("total").alias("n"),
        F.col("row.leaf").alias("digest"),
        F.col("row").alias("own"),
    )
    levels = _levels(leaves.agg(F.max("n")).first()[0] or 0, fanout)
    runs = _runs(leaves, 0, fanout)
    lone = leaves.where(F.col("n") == 1).withColumn("node", _node(F.col("tree"), 0, F.col("place")))
    steps, tops = _climbed(runs.drop("members"), max(0, levels - 1), 1, fanout)
    tops = tops.union(lone.select("tree", "digest", F.col("node").alias("own")))
    ordered = numbered(tops.withColumn("all", F.lit("")), "all", ["tree"], ["digest", "own"])
    subroots = cut(ordered.select(F.col("all").alias("tree"), F.col("number").alias("place"), F.col("total").alias("n"), "digest", "own"))
    upper = _levels(subroots.agg(F.max("n")).first()[0] or 0, fanout)
    top_steps, top = _climbed(subroots, upper, 0, fanout)
    found = top.select("own", "digest").first()
    root, digest = (found["own"], bytes(found["digest"])) if found else ("", b"")

    leaves = _siblings(runs).select(F.col("up").alias("node"), F.col("member.own").alias("row"), F.array("step").alias("path"))
    alone = lone.select("node", F.col("own").alias("row"), F.array().alias("path"))
    paths = leaves.withColumn("path", F.col("path").cast(_SEGMENT)).union(alone.withColumn("path", F.col("path").cast(_SEGMENT)))
    unknown, nodes = F.lit(None).cast("binary"), None
    for some in [*top_steps, *steps]:
        # The first of the upper steps are those of the subroots.
        subroot = F.col("digest") if nodes is None and top_steps else unknown
        some = some.select("own", "up", F.array("step").cast(_SEGMENT).alias("segment"), subroot.alias("subroot"))
        nodes = some if nodes is None else nodes.union(some)
    if nodes is None:
        paths = paths.withColumns({"segment": F.array().cast(_SEGMENT), "subroot": unknown})
    else:
        paths = paths.join(jumped(nodes, root, levels + upper), F.col("node") == F.col("own"), "left")
    whole = F.concat("path", F.coalesce("segment", F.array().cast(_SEGMENT)))
    return paths.select(
        "row",
        F.coalesce("subroot", F.lit(digest)).alias("subroot"),
        F.lit(digest).alias("root"),
        whole.alias("path"),
    )


def folded(digest: Column, path: Column) -> Column:
    """The root, as hex, that a leaf and its siblings give."""

    def up(own: Column, step: Column) -> Column:
        return F.sha2(F.concat(_hex(step["before"]), own, _hex(step["after"])), 256)

    return F.aggregate(path, _hex(digest), up)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered (the leaf after tampering), subroot, root and path of each document.

    Documents whose id has a CRC-32 divisible by 3 are tampered with: A-Z in
    their text become small letters. The others have no tampered leaf.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = leaf(*fields, F.translate("text", _CAPITALS, _SMALL))
    rows = docs.select(
        F.col("lang").alias("tree"),
        leaf(*fields, F.col("text")).alias("leaf"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered).alias("tampered"),
    )
    return proofs(rows, ["doc_id"]).select("row.doc_id", "row.leaf", "row.tampered", "subroot", "root", "path")


def verify(rows: DataFrame) -> DataFrame:
    """The manifest with digests as hex, its proofs hashed, and whether the leaf still gives the root."""
    siblings = F.transform("path", lambda step: F.concat(_hex(step["before"]), _hex(step["after"])))
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    checked = rows.select(
        "doc_id",
        *(_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")),
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        again.alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
