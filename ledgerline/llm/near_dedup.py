"""Near-duplicate groups by b-bit MinHash.

A document's set holds its distinct shingles of five words. Equal sets form
a class, and only classes are compared:

1. 240 minima of hashed shingles are taken per class. Five at a time they
   make 48 band keys; of each minimum two low bits are kept and packed.
   Sets that are alike to 0.75 share no band in 2 of 1,000,000 cases.
2. Under each band key the classes meet the most central of them, the one
   that shares its bands with most others. In a group of copies that is one
   close to the original: nearly all that are linked at all are linked to
   it, and a group of any size gives few pairs.
3. Of each such pair the packed bits are compared by bit counts. Unlike
   minima agree in a quarter of cases, so the similarity is estimated as
   (agreeing share - 1/4) / (3/4). Pairs below 0.6, 4.4 standard errors
   under 0.75, are left out: 5 in 1,000,000 that are just alike enough.
4. For each class its most similar partner is confirmed on full sets of
   64-bit shingle hashes, which joins most of each group.
5. What is still apart is compared whatever the size of a key. Each class has
   one home among the band keys that more than one component shares, its
   largest, and the classes of a home are dealt into pieces. Pieces that have
   a key in common meet, once however many keys they share. A component of
   256 classes or more has pieces of its own, which don't meet each other.
   Where pieces meet, signatures are compared first, and only classes that
   may be alike to one of another component stay. Their full sets meet in a
   second step, all pairs at once as a product of shingle incidences, and
   what leaves the task is a spanning forest of the confirmed links: fewer
   rows than classes, and none where nothing is linked.

In step 4 sets are compared in cells of a grid of hashed nodes, so a set is
sent once to each cell that has a pair of it. Comparisons within a crowd of
classes that share keys and are not linked grow with the square of the
crowd; rows grow with classes times pieces met.

Sets are named by 64 bits. Two of 10**9 different sets have the same name in
3 of 100 corpora, and would then count as equal.

Defined results: documents without words (null, empty) have an empty set
and are linked with nothing; fewer than five words make one shingle;
documents without an id are linked with nothing and kept; repeated rows get
equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_BYTES, cut, ship, spaced_words

WORDS = 5
ROWS, BANDS = 5, 48
MINIMA = ROWS * BANDS
BITS = 2
_LONGS = -(-MINIMA * BITS // 64)
#: Percent of the union that linked sets have in common.
PERCENT = 75
#: Least estimated similarity of a pair that is confirmed on full sets.
ESTIMATE = 0.6
#: Classes that make one piece, about, and shingles.
PIECE, _PIECE_SHINGLES = 256, 1 << 18
#: Links that a task puts together at once.
_LINKS = 1 << 20
#: Columns of a part of an incidence matrix.
_PART = 8192
#: Bytes of full sets in a row or column of cells, about, and the least number of these.
_CELL_BYTES, _LEAST_CELLS = 8 << 20, 16

_random = np.random.Generator(np.random.PCG64(2))
_MULTIPLY = _random.integers(0, 1 << 31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _random.integers(0, 1 << 32, MINIMA, np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of a public hash (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles, or of the one shorter sequence."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    count = len(words) - width + 1
    rolled = np.full(count, width, np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + hashes[k : k + count]
    return np.unique(_mixed(rolled))


def minima(shingle: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    x = (shingle >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(x), 2048):
        some = x[first : first + 2048]
        np.minimum(least, (_MULTIPLY[:, None] * some + _ADD[:, None]).min(1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """Two low bits of each (mixed) minimum, as 64-bit integers."""
    low = _mixed(least.astype(np.uint64)).astype(np.uint8) & np.uint8(3)
    bits = np.zeros(_LONGS * 64, np.uint8)
    bits[: 2 * MINIMA : 2] = low & 1
    bits[1 : 2 * MINIMA : 2] = low >> 1
    return np.packbits(bits, bitorder="little").view("<i8")


def bands(least: np.ndarray) -> np.ndarray:
    """A key per band, different bands having different keys."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _STEP + row)
    return keys.view(np.int64)


def set_key(shingle: np.ndarray) -> int:
    """64 bits for a set, whatever the order of its members."""
    total = _mixed(shingle + _STEP).sum(dtype=np.uint64) + np.uint64(len(shingle))
    return int(_mixed(np.array([total], np.uint64)).view(np.int64)[0])


_SIGNED = "doc_id bigint, n_shingles bigint, node bigint, bits array<bigint>, bands array<bigint>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            some = batch.slice(first, 1024)
            sizes, nodes, bits, keys = [], [], [], []
            for text in some.column("text").to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                least = minima(own) if len(own) else None
                nodes.append(None if least is None else set_key(own))
                bits.append(None if least is None else packed(least))
                keys.append(None if least is None else bands(least))
            long_list = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(bits, long_list),
                    pa.array(keys, long_list),
                ],
                ["doc_id", "n_shingles", "node", "bits", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            own = [shingles(t) for t in batch.slice(first, 256).column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([set_key(s) if len(s) else None for s in own], pa.int64()),
                    pa.array([s.tobytes() for s in own], pa.binary()),
                ],
                ["node", "members"],
            )


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alike pairs of rows sorted by cell, in each of which the sets come before the pairs."""
    cell, sets = None, {}
    for batch in batches:
        out: tuple[list, list] = ([], [])
        columns = (batch.column(c).to_pylist() for c in ("cell", "a", "b"))
        for at, (own, a, b) in enumerate(zip(*columns, strict=True)):
            if own != cell:
                cell, sets = own, {}
            if b is None:
                sets[a] = np.frombuffer(batch.column("members")[at].as_py(), np.uint64)
            elif a in sets and b in sets and _alike(sets[a], sets[b]):
                out[0].append(a)
                out[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])


def _columns(piece: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, root, n_shingles and bits of a piece."""
    node, root, size = (piece.field(c).to_numpy() for c in ("node", "root", "n_shingles"))
    return node, root, size, piece.field("bits").flatten().to_numpy().view(np.uint64).reshape(-1, _LONGS)


def may_be_alike(left: tuple, right: tuple) -> np.ndarray:
    """Which classes of two pieces are in different components and alike by estimate, or nearly."""
    # A pair of bits differs if either does; 0x5555... picks one place per pair.
    places, chance = np.uint64(0x5555555555555555), 0.5**BITS
    most = int(MINIMA * (1 - chance - ESTIMATE * (1 - chance)) + 1e-6)
    (_, root, size, bits), (_, other_root, other_size, other_bits) = left, right
    out = np.zeros((len(root), len(other_root)), bool)
    for first in range(0, len(root), PIECE):
        own = slice(first, first + PIECE)
        unlike = np.zeros(out[own].shape, np.int16)
        for k in range(_LONGS):
            odd = bits[own, k, None] ^ other_bits[None, :, k]
            unlike += np.bitwise_count((odd | (odd >> np.uint64(1))) & places)
        a, b = size[own, None], other_size[None, :]
        near = (unlike <= most) & (root[own, None] != other_root[None, :])
        out[own] = near & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
    return out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each meeting the classes that may be alike to one of the other piece."""
    for batch in batches:
        for at in range(batch.num_rows):
            meeting = batch.column("meeting")[at].as_py()
            left = _columns(batch.column("left")[at].values)
            right = _columns(batch.column("right")[at].values)
            near = may_be_alike(left, right)
            within = batch.column("within")[at].as_py()
            sides = [(left, near.any(1), 0)] + ([] if within else [(right, near.any(0), 1)])
            nodes, roots = (np.concatenate([s[0][c][s[1]] for s in sides]) for c in (0, 1))
            side = np.concatenate([np.full(int(s[1].sum()), -1 if within else s[2]) for s in sides])
            arrays = [pa.array(np.full(len(nodes), meeting)), *map(pa.array, (nodes, roots, side.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(arrays, ["meeting", "node", "root", "side"])


def alike_sets(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of the sets on the left are alike to which on the right."""

    def all_(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (a, in_a), (b, in_b) = all_(left), all_(right)
    shared = np.intersect1d(a, b)
    common = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, len(shared), _PART):
        part = shared[first : first + _PART]
        tables = []
        for members, owner, n in ((a, in_a, len(left)), (b, in_b, len(right))):
            at = np.minimum(np.searchsorted(part, members), len(part) - 1)
            here = part[at] == members
            table = np.zeros((n, len(part)), np.float32)
            table[owner[here], at[here]] = 1
            tables.append(table)
        common += np.rint(tables[0] @ tables[1].T).astype(np.int64)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])
    return 100 * common >= PERCENT * (sizes - common)


def forest(pairs: Iterator[tuple[int, int]], label: dict[int, int]) -> list[tuple[int, int]]:
    """Those of the pairs that join two components; `label` has each node's at first."""
    top = {root: root for root in label.values()}

    def found(node: int) -> int:
        at = label[node]
        while top[at] != at:
            top[at] = at = top[top[at]]
        return at

    kept = []
    for a, b in pairs:
        x, y = found(a), found(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _links(rows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links of one meeting, from node, root, side and set."""
    left, right = ([r for r in rows if r[2] in (side, -1)] for side in (0, 1))
    if not left or not right:
        return []
    alike = alike_sets([r[3] for r in left], [r[3] for r in right])
    i, j = np.nonzero(alike)
    label = {r[0]: r[1] for r in rows}
    pairs = ((left[a][0], right[b][0]) for a, b in zip(i.tolist(), j.tolist(), strict=True))
    return [(max(p), min(p)) for p in forest(pairs, label)]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by meeting."""
    meeting, rows = None, []

    def out() -> pa.RecordBatch:
        links = _links(rows)
        arrays = [pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("meeting", "node", "root", "side"))
        for at, (own, *row) in enumerate(zip(*columns, strict=True)):
            if own != meeting:
                yield out()
                meeting, rows = own, []
            rows.append((*row, np.frombuffer(batch.column("members")[at].as_py(), np.uint64)))
    yield out()


def crowds(classes: DataFrame) -> DataFrame:
    """node, bands and crowds of the nodes that share a band key, and their score.

    `crowds` has the number of nodes under each of `bands`; the score is
    their sum.
    """
    keyed = classes.select("node", F.explode("bands").alias("band"))
    sizes = cut(keyed.groupBy("band").agg(F.count("*").alias("crowd")).where(F.col("crowd") > 1))
    return (
        keyed.join(sizes, "band")
        .groupBy("node")
        .agg(F.sum("crowd").alias("score"), F.collect_list(F.struct("band", "crowd")).alias("shared"))
    )


def central_pairs(crowded: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of each node and the most central one under each of its keys."""
    keyed = crowded.select("node", "score", F.explode("shared.band").alias("band"))
    tops = cut(keyed.groupBy("band").agg(F.max(F.struct("score", "node")).alias("top")))
    met = keyed.join(tops, "band").select("node", F.col("top.node").alias("other"))
    return _ordered(met.where(F.col("node") != F.col("other")))


def meetings(crowded: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pieces that share a key with more than one component: meeting, left, right (their classes), within."""
    keyed = cut(
        crowded.join(roots, "node", "left").select(
            "node", F.coalesce("root", "node").alias("root"), F.explode("shared").alias("key")
        )
    )
    mixed = keyed.groupBy("key.band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = cut(mixed.where(F.col("low") != F.col("high")).select(F.col("band").alias("mixed")))
    keyed = cut(keyed.join(mixed, F.col("key.band") == F.col("mixed")).select("node", "root", "key.band", "key.crowd"))
    homes = keyed.groupBy("node", "root").agg(F.max(F.struct("crowd", "band")).alias("home"))
    homes = homes.join(classes.select("node", "n_shingles", "bits"), "node")
    homes = cut(homes.select("node", "root", F.col("home.band").alias("home"), "n_shingles", "bits"))
    held = homes.groupBy("home", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    # A large component has pieces of its own; the others of a home share theirs.
    large = F.col("n") >= PIECE
    rest = held.where(~large).groupBy(F.col("home").alias("rest_home"))
    rest = rest.agg(F.sum("n").alias("rest_n"), F.sum("weight").alias("rest_weight"))
    held = held.join(rest, F.col("home") == F.col("rest_home"), "left")
    count = lambda n, weight: F.greatest(F.ceil(F.col(n) / PIECE), F.ceil(F.col(weight) / _PIECE_SHINGLES))
    held = cut(
        held.select(
            F.col("home").alias("held_home"),
            F.col("root").alias("held_root"),
            F.when(large, F.col("root")).alias("own"),
            F.when(large, count("n", "weight")).otherwise(count("rest_n", "rest_weight")).alias("pieces"),
        )
    )
    number = F.pmod(F.xxhash64("node"), F.col("pieces"))
    piece = F.struct("home", F.col("own").isNotNull().alias("is_own"), F.coalesce("own", F.lit(0)).alias("own"), number.alias("number"))
    placed = homes.join(held, (F.col("home") == F.col("held_home")) & (F.col("root") == F.col("held_root")))
    placed = cut(placed.select("node", "root", "n_shingles", "bits", piece.alias("piece")))
    members = F.collect_list(F.struct("node", "root", "n_shingles", "bits")).alias("members")
    pieces = cut(placed.groupBy("piece").agg(members))
    found = cut(keyed.join(placed.select("node", "piece"), "node").select("band", "piece").distinct())
    both = found.join(found.toDF("band", "other"), "band").where(F.col("piece") <= F.col("other"))
    same = F.col("piece.is_own") & F.col("other.is_own") & (F.col("piece.home") == F.col("other.home"))
    same = same & (F.col("piece.own") == F.col("other.own"))
    met = cut(both.where(~same).select("piece", "other").distinct().withColumn("meeting", F.monotonically_increasing_id()))
    return (
        met.join(pieces.toDF("piece", "left"), "piece")
        .join(pieces.toDF("other", "right"), "other")
        .select("meeting", "left", "right", (F.col("piece") == F.col("other")).alias("within"))
    )


def apart_links(crowded: DataFrame, classes: DataFrame, roots: DataFrame, bodies: DataFrame, firsts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that join all components that share a key and are linked."""
    met = meetings(crowded, classes, roots)
    candidates = cut(met.mapInArrow(_candidates, "meeting bigint, node bigint, root bigint, side int"))
    sets = _full_sets(candidates.select("node").distinct(), bodies, firsts)
    rows = candidates.join(sets, "node").select("meeting", "node", "root", "side", "members")
    rows = rows.repartition("meeting").sortWithinPartitions("meeting")
    return cut(rows.mapInArrow(_forests, "a bigint, b bigint"))


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that may be alike, with their estimated similarity."""
    pairs = cut(pairs)
    signed = classes.select("node", "n_shingles", "bits")
    for side in ("a", "b"):
        named = signed.toDF(side, f"n_{side}", f"bits_{side}")
        pairs = pairs.join(named, side)
    odd = F.zip_with("bits_a", "bits_b", lambda x, y: x.bitwiseXOR(y))
    # A pair of bits differs if either does; 0x5555... picks one place per pair.
    unlike = F.transform(
        odd,
        lambda x: F.bit_count(
            x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        ),
    )
    agreeing = 1 - F.aggregate(unlike, F.lit(0), lambda total, n: total + n) / MINIMA
    chance = 0.5**BITS
    pairs = pairs.withColumn("estimate", (agreeing - chance) / (1 - chance))
    fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return cut(pairs.where(fits & (F.col("estimate") >= ESTIMATE)).select("a", "b", "estimate"))


def _full_sets(nodes: DataFrame, bodies: DataFrame, firsts: DataFrame) -> DataFrame:
    """node and members, the sorted shingles of each of the nodes."""
    wanted = cut(firsts.join(nodes, "node").select(F.col("first_id").alias("doc_id")).distinct())
    if wanted.count() * 32 < BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    texts = bodies.join(wanted, "doc_id", "left_semi")
    # A row may be repeated any number of times.
    return cut(texts.mapInArrow(_sets, "node bigint, members binary").dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, bodies: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs whose full sets are alike. `firsts`: node and one document of it."""
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), bodies, firsts)
    size = sets.agg(F.sum(F.octet_length("members"))).first()[0] or 0
    cells = max(_LEAST_CELLS, -(-size // _CELL_BYTES))
    place = lambda node: F.pmod(F.xxhash64(node), F.lit(cells))
    # A pair is the same either way round, and so is its cell.
    low, high = F.least(place("a"), place("b")), F.greatest(place("a"), place("b"))
    placed = cut(pairs.select((low * cells + high).alias("cell"), "a", "b"))
    needed = placed.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = needed.join(sets, "node").select("cell", F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "members")
    rows = rows.union(placed.select("cell", "a", "b", F.lit(None).cast("binary").alias("members")))
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.col("b").isNotNull())
    return cut(rows.mapInArrow(_confirmed, "a bigint, b bigint").distinct())


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each node to the least one it is connected to by some `_LINKS` links."""

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate(parts), return_inverse=True)
        at = at.reshape(-1, 2)
        label = np.arange(len(ids))
        while True:
            x, y = label[at[:, 0]], label[at[:, 1]]
            at, x, y = at[x != y], x[x != y], y[x != y]
            if not len(at):
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != (top := label[label])).any():
                label = top
        far = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], ["a", "b"])

    parts, n = [], 0
    for batch in batches:
        parts.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], 1).ravel())
        n += batch.num_rows
        if n >= _LINKS:
            yield out(parts)
            parts, n = [], 0
    if n:
        yield out(parts)


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b); root is the component's least node.

    Tasks first replace their links by stars. Then each round takes the
    least label among the neighbours and then the label of that label, so
    chains shorten by half a round. Only the number of changed labels
    reaches the driver.
    """
    links = cut(links.select("a", "b"))
    # As many tasks as the links need, not as many as made them.
    tasks = max(1, -(-links.count() // _LINKS))
    links = links.where(F.col("a") != F.col("b")).coalesce(tasks).mapInArrow(_stars, "a bigint, b bigint")
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    both = cut(links.select(F.explode(ends).alias("ends")).select("ends.*"))
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
    while True:
        heard = (
            both.join(labels.toDF("other", "heard"), "other")
            .groupBy("node")
            .agg(F.min("heard").alias("heard"))
        )
        nearer = cut(
            labels.join(heard, "node").select(
                "node", F.least("root", "heard").alias("root"), F.col("root").alias("was")
            )
        )
        further = nearer.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = cut(
            nearer.join(further, "root", "left").select(
                "node", F.least("root", F.coalesce("next", "root")).alias("root"), "was"
            )
        )
        changed = jumped.where(F.col("root") != F.col("was")).limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    ship(docs.sparkSession)
    bodies = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    signed = cut(bodies.mapInArrow(_signed, _SIGNED))
    named = signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    # A class is stood for by its smallest document.
    firsts = cut(named.groupBy("node").agg(F.min("doc_id").alias("first_id")))
    classes = cut(
        named.withColumnRenamed("doc_id", "first_id")
        .join(firsts, ["node", "first_id"])
        .select("node", "n_shingles", "bits", "bands")
        .dropDuplicates(["node"])
    )
    crowded = cut(crowds(classes))
    pairs = estimated(central_pairs(crowded), classes)
    best = pairs.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("best"))
    best = cut(best.select("a", F.col("best.b").alias("b")))
    links = confirmed(best, bodies, firsts)
    roots = components(links)
    links = links.union(apart_links(crowded, classes, roots, bodies, firsts))
    roots = components(links)

    members = firsts.join(roots, "node", "left").select(
        "node", "first_id", F.coalesce("root", "node").alias("root")
    )
    leads = cut(members.groupBy("root").agg(F.min("first_id").alias("component_id")))
    members = cut(members)
    groups = cut(members.join(leads, "root").select("node", "component_id"))
    rows = signed.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")
    )
    # Documents linked with nothing are joined apart, or they would all meet in one task.
    alone = rows.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = rows.where(F.col("node").isNotNull()).join(groups, "node")
    out = linked.select("doc_id", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns; a kept id keeps its rows."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct("*").alias("doc"))
    return rows.join(cut(gone), F.col("doc.doc_id") == F.col("gone_id"), "left_anti").select("doc.*")
