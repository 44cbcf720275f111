"""Trie of rebuilt conversations by composable fingerprints.

A conversation is rebuilt from the first turns of its base and its own later
turns. No rebuilt text is ever put together. Each turn has four hashes x; a
sequence has the fingerprint sum of x_i * B**i, modulo four primes with a
base B each. Such sums form a monoid in which parts are joined by shifting
one of them: from running sums over the stored turns, the fingerprint of a
head followed by a part of another conversation is

    head(h) + (own(i) - own(skipped)) * B ** (h - skipped)

so every prefix of every rebuilt conversation gets its fingerprint from its
own row, its conversation's few constants and nothing else. Prefixes of
equal depth and fingerprint are a node.

Equality is verified, not assumed: a prefix refers to the stored turn that
ends it and to its own prefix, one turn shorter. A node's members must agree
in both, and stored turns of equal hashes in role and text; then, depth by
depth, equal fingerprints are equal sequences. Else everything is done again
with other hashes.

A conversation may hold any share of the turns, a node any share of the
conversations. Turns are numbered and summed by ranges, nodes are made by
partial aggregates, and sums over subtrees by pointers to ancestors whose
distance doubles. The digest of the ids that end at a node is one hash by
definition: ids are put together in pieces of `PIECE`, and one task reads a
node's pieces as a stream.

Defined results: null roles and texts are empty; turns come by number, null
first, equal numbers by role and text; rows without a conversation id are
left out; a conversation of which nothing is left ends at the root; an empty
table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, ship
from ledgerline.llm.ordering import numbered, running

BLOCK, FOLDS = 100, 6
#: Ids put together before they are hashed.
PIECE = 256
# The four largest primes below 2**31.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_N = range(len(PRIMES))
_SUMS = [f"sum_{k}" for k in _N]
_TERMS = [f"term_{k}" for k in _N]


def _bases(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed} {p}".encode()).digest()[:8]) % (p - 2) + 2 for p in PRIMES]


def _powers(base: int, prime: int, exponents: np.ndarray) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def _weighted(seed: int):
    """Adds to each numbered turn its terms, hash times power of the base."""

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = _bases(seed)
        for batch in batches:
            number = batch.column("number").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(PRIMES))
            for k in _N:
                term = x[:, k] * _powers(bases[k], PRIMES[k], number) % PRIMES[k]
                batch = batch.append_column(_TERMS[k], pa.array(term, pa.int64()))
            yield batch

    return weighted


def _pair(values: list[Column]) -> Column:
    """Four values below 2**31 in two numbers."""
    first, second = (F.shiftleft(a, 31).bitwiseOR(b) for a, b in (values[:2], values[2:]))
    return F.struct(first.alias("a"), second.alias("b"))


def stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """Turns of each conversation in order: conv_id, number, total, size, x, terms and running sums of these."""
    empty = F.lit("")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("by_turn"),
        F.coalesce("role", empty).alias("by_role"),
        F.coalesce("text", empty).alias("by_text"),
    )
    hashes = [F.pmod(F.xxhash64(F.lit(seed * 16 + k), "by_role", "by_text"), F.lit(p - 1)) + 1 for k, p in enumerate(PRIMES)]
    rows = rows.withColumns({"x": F.array(*hashes), "size": F.length("by_text").cast("bigint")})
    rows = numbered(rows, "conv_id", ["by_turn", "by_role", "by_text"], ["x", "size"])
    shape = "conv_id bigint, x array<bigint>, size bigint, at bigint, number bigint, total bigint, "
    rows = cut(rows.mapInArrow(_weighted(seed), shape + ", ".join(f"{t} bigint" for t in _TERMS)))
    sums = {s: F.col(t) for s, t in zip(_SUMS, _TERMS, strict=True)}
    rows = running(rows, "conv_id", sums, ["x", "size", "number", "total", *_TERMS])
    return cut(rows.drop("at").withColumns({s: F.col(s) % p for s, p in zip(_SUMS, PRIMES, strict=True)}))


def hashes_agree(conversations: DataFrame, seed: int) -> bool:
    """Whether stored turns of equal hashes are equal."""
    turn = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    x = [F.xxhash64(F.lit(seed * 16 + k), "turn.role", "turn.text") for k in _N]
    x = [F.pmod(h, F.lit(p - 1)).alias(f"x_{k}") for k, (h, p) in enumerate(zip(x, PRIMES, strict=True))]
    groups = conversations.select(turn.alias("turn")).groupBy(*x).agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    return not groups.where(F.col("lo") != F.col("hi")).limit(1).count()


def _plans(turns: DataFrame, seed: int, block: int, folds: int) -> DataFrame:
    """Per conversation: skipped own turns, the base's turns taken (`taken`, `heads`), and what turns sums into fingerprints."""
    first = F.struct("number", "x", "size", *_TERMS, *_SUMS)
    convs = cut(
        turns.where(F.col("number") < folds - 1)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(first)).alias("first"), F.max("total").alias("total"))
    )
    bases = convs.select(F.col("conv_id").alias("base_id"), F.col("first").alias("base_first"))
    convs = convs.withColumn("skipped", (F.crc32(F.col("conv_id").cast("string")) % folds).cast("int"))
    convs = convs.join(bases, F.col("conv_id") - F.col("conv_id") % block == F.col("base_id"), "left")
    heads = F.slice(F.coalesce("base_first", F.slice("first", 1, 0)), F.lit(1), F.col("skipped"))
    convs = convs.select("conv_id", "first", "total", "skipped", heads.alias("heads"))
    convs = convs.withColumn("taken", F.size("heads"))
    starts, factors = [], []
    for k, (base, p) in enumerate(zip(_bases(seed), PRIMES, strict=True)):
        shifts = F.array(*(F.lit(pow(base, -n, p)).cast("bigint") for n in range(folds)))
        factor = F.element_at(shifts, F.col("skipped") - F.col("taken") + 1)
        head = F.coalesce(F.try_element_at("heads", F.nullif("taken", F.lit(0)))[_SUMS[k]], F.lit(0))
        skipped = F.coalesce(F.try_element_at("first", F.nullif("skipped", F.lit(0)))[_SUMS[k]], F.lit(0))
        starts.append(F.pmod(head - skipped * factor % p, F.lit(p)).alias(f"start_{k}"))
        factors.append(factor.alias(f"factor_{k}"))
    rest = F.greatest(F.col("total") - F.col("skipped"), F.lit(0))
    return cut(convs.select("conv_id", "heads", "skipped", "taken", (rest + F.col("taken")).alias("length"), *starts, *factors))


def _prefixes(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, depth, length, node and above (fingerprints), x and size of the last turn, for each prefix but the empty one."""

    def prefix(depth: Column, sums: list[Column], terms: list[Column], x: Column, size: Column) -> list[Column]:
        above = [F.pmod(s - t, F.lit(p)) for s, t, p in zip(sums, terms, PRIMES, strict=True)]
        last = _pair([x[k] for k in _N])
        named = zip((depth.cast("bigint"), _pair(sums), _pair(above), last, size), ("depth", "node", "above", "x", "size"), strict=True)
        return ["conv_id", "length", *(c.alias(name) for c, name in named)]

    head = plans.select("conv_id", "length", F.explode("heads").alias("t"))
    fields = lambda names: [F.col(f"t.{name}") for name in names]
    heads = head.select(*prefix(F.col("t.number") + 1, fields(_SUMS), fields(_TERMS), F.col("t.x"), F.col("t.size")))
    own = turns.join(plans.drop("heads"), "conv_id").where(F.col("number") >= F.col("skipped"))
    depth = F.col("number") - F.col("skipped") + F.col("taken") + 1
    sums = [(F.col(f"start_{k}") + F.col(_SUMS[k]) * F.col(f"factor_{k}")) % p for k, p in enumerate(PRIMES)]
    terms = [F.col(_TERMS[k]) * F.col(f"factor_{k}") % p for k, p in enumerate(PRIMES)]
    return heads.union(own.select(*prefix(depth, sums, terms, F.col("x"), F.col("size"))))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, from its pieces in order."""
    key, hashed = None, None
    for batch in batches:
        out: list[tuple] = []
        for depth, node, ids in zip(*(batch.column(c) for c in ("depth", "node", "ids")), strict=True):
            own = (depth.as_py(), node["a"].as_py(), node["b"].as_py())
            if own != key:
                if key is not None:
                    out.append((*key, hashed.hexdigest()))
                key, hashed = own, hashlib.sha256()
            else:
                hashed.update(b",")
            hashed.update(ids.as_py().encode())
        yield _digests(out)
    if key is not None:
        yield _digests([(*key, hashed.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["depth", "a", "b", "ends_sha256"])


def _ends(prefixes: DataFrame, plans: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at a node: depth, node, ends_sha256."""
    zero = _pair([F.lit(0).cast("bigint") for _ in _N])
    ends = prefixes.where(F.col("depth") == F.col("length")).select("conv_id", "depth", "node")
    ends = ends.union(plans.where(F.col("length") == 0).select("conv_id", F.lit(0).cast("bigint"), zero))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", "node", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(ids.alias("ids"))
    pieces = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "piece")
    found = pieces.mapInArrow(_digested, "depth bigint, a bigint, b bigint, ends_sha256 string")
    return found.select("depth", F.struct("a", "b").alias("node"), "ends_sha256")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves and saved_tokens summed over each node's subtree.

    `nodes`: conv_id, depth, up (conv_id of the parent), leaf, saved. After k
    rounds a node has the sums of all that is less than 2**k below it, and
    points at its ancestor 2**k above.
    """
    sums = cut(
        nodes.select(
            "conv_id",
            "depth",
            F.col("up").alias("far_id"),
            F.when(F.col("up").isNotNull(), F.col("depth") - 1).alias("far_depth"),
            F.col("leaf").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
        )
    )
    while True:
        waiting = sums.where(F.col("far_id").isNotNull())
        more = waiting.groupBy(F.col("far_id").alias("to_id"), F.col("far_depth").alias("to_depth")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens")
        )
        further = sums.select(
            F.col("conv_id").alias("met_id"),
            F.col("depth").alias("met_depth"),
            F.col("far_id").alias("next_id"),
            F.col("far_depth").alias("next_depth"),
        ).where(F.col("next_id").isNotNull())
        met = (F.col("far_id") == F.col("met_id")) & (F.col("far_depth") == F.col("met_depth"))
        # Most nodes stop pointing early; those that point at the root need no join.
        moved = waiting.where(F.col("far_depth") > 0).join(further, met)
        moved = moved.select("conv_id", "depth", F.col("next_id").alias("far_id"), F.col("next_depth").alias("far_depth"))
        moved = moved.toDF("at_id", "at_depth", "far_id", "far_depth")
        if not waiting.limit(1).count():
            return sums.select("conv_id", "depth", "n_leaves", "saved_tokens")
        sums = cut(
            sums.drop("far_id", "far_depth")
            .join(more, (F.col("conv_id") == F.col("to_id")) & (F.col("depth") == F.col("to_depth")), "left")
            .join(moved, (F.col("conv_id") == F.col("at_id")) & (F.col("depth") == F.col("at_depth")), "left")
            .select(
                "conv_id",
                "depth",
                "far_id",
                "far_depth",
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("more_tokens", F.lit(0))).alias("saved_tokens"),
            )
        )


def _grouped(conversations: DataFrame, seed: int, block: int, folds: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Plans, prefixes, nodes, and whether all members of each node agree."""
    turns = stored_turns(conversations, seed)
    plans = _plans(turns, seed, block, folds)
    prefixes = cut(_prefixes(turns, plans))
    last = F.struct("above", "x")
    nodes = cut(
        prefixes.groupBy("depth", "node").agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.max("size").alias("size"),
            F.min(last).alias("last"),
            F.max(last).alias("other"),
        )
    )
    agree = not nodes.where(F.col("last") != F.col("other")).limit(1).count()
    return plans, prefixes, nodes, agree and hashes_agree(conversations, seed)


def prefix_trie(conversations: DataFrame, *, block: int = BLOCK, folds: int = FOLDS, seed: int = 13) -> DataFrame:
    """A row per node of the trie of rebuilt conversations.

    Conversation c takes its head, crc32(c) % `folds` turns, from c - c % `block`.
    """
    ship(conversations.sparkSession)
    plans, prefixes, nodes, agree = _grouped(conversations, seed, block, folds)
    while not agree:
        seed += 1
        plans, prefixes, nodes, agree = _grouped(conversations, seed, block, folds)
    zero = _pair([F.lit(0).cast("bigint") for _ in _N])
    root = plans.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where(F.col("n_convs") > 0)
    root = root.select(F.lit(0).cast("bigint").alias("depth"), zero.alias("node"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("size"))
    nodes = nodes.select("depth", "node", "conv_id", "n_convs", "size", F.col("last.above").alias("above"))
    nodes = cut(nodes.union(root.withColumn("above", F.lit(None).cast("struct<a:bigint,b:bigint>"))))
    parents = nodes.select(
        (F.col("depth") + 1).alias("below"), F.col("node").alias("met"), F.col("conv_id").alias("up")
    )
    families = nodes.where(F.col("depth") > 0).groupBy(
        (F.col("depth") - 1).alias("up_depth"), F.col("above").alias("up_node")
    )
    families = families.agg(F.count("*").alias("n_children"))
    nodes = nodes.join(parents, (F.col("depth") == F.col("below")) & (F.col("above") == F.col("met")), "left")
    nodes = nodes.join(families, (F.col("depth") == F.col("up_depth")) & (F.col("node") == F.col("up_node")), "left")
    nodes = cut(
        nodes.select(
            "conv_id",
            "depth",
            "node",
            "up",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("n_children").isNull().cast("bigint").alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
        )
    )
    ends = _ends(prefixes, plans).toDF("end_depth", "end_node", "ends_sha256")
    sums = _subtrees(nodes).toDF("sum_id", "sum_depth", "n_leaves", "saved_tokens")
    return (
        nodes.join(sums, (F.col("conv_id") == F.col("sum_id")) & (F.col("depth") == F.col("sum_depth")))
        .join(ends, (F.col("depth") == F.col("end_depth")) & (F.col("node") == F.col("end_node")), "left")
        .select(
            "conv_id",
            "depth",
            F.col("up").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
