from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import near_dedup
from ledgerline.llm.near_dedup import components, deduplicated, near_duplicates
from tests.llm.cases import MEDIUM, as_rows, documents, edge_docs, no_docs


def plain_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_components(rows):
    """Every pair with a shingle in common, compared on full sets."""
    sets = {doc_id: plain_set(text) for doc_id, text in rows}
    holders = defaultdict(list)
    for doc_id, own in sets.items():
        for shingle in own:
            holders[shingle].append(doc_id)
    common = Counter()
    for ids in holders.values():
        ids.sort()
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    root = {doc_id: doc_id for doc_id in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return sorted((d, len(sets[d]), top(d), top(d) == d) for d in sets)


def test_equals_all_pairs(spark):
    docs = documents(spark, MEDIUM)
    expected = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, near_duplicates(docs).collect())) == expected
    assert any(not row[3] for row in expected)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for doc_id in range(400):
        own = list(words)
        for at in rng.integers(0, 120, 3):
            own[at] = f"x{rng.integers(1 << 40)}"
        rows.append((doc_id, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, near_duplicates(docs).collect())) == plain_components(rows)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(5)
    for similarity in (0.3, 0.5, 0.75, 0.9):
        errors = []
        for _ in range(30):
            n = 600
            both = int(round(2 * n * similarity / (1 + similarity)))
            pool = rng.integers(0, 1 << 63, 2 * n - both, np.int64).astype(np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
            bits = near_dedup.packed(near_dedup.minima(a)) ^ near_dedup.packed(near_dedup.minima(b))
            unlike = sum(bin((int(x) | (int(x) >> 1)) & 0x5555555555555555).count("1") for x in bits.view(np.uint64))
            errors.append((1 - unlike / near_dedup.MINIMA - 0.25) / 0.75 - similarity)
        assert abs(np.mean(errors)) < 0.03
        assert np.max(np.abs(errors)) < 0.2


def test_chain_of_components(spark):
    links = [(i, i + 1) for i in range(40) if i != 20] + [(100, 3)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r.node: r.root for r in components(frame).collect()}
    assert {found[i] for i in [*range(21), 100]} == {0}
    assert {found[i] for i in range(21, 41)} == {21}


def test_components_of_random_links(spark, monkeypatch):
    """The same in one task and in many, each of which sees a part of every chain."""
    rng = np.random.default_rng(13)
    links = [tuple(map(int, rng.integers(0, 400, 2) * 7 - 300)) for _ in range(300)]
    top = {n: n for link in links for n in link}
    for _ in range(400):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(16)
    expected = {n: t for n, t in top.items() if any(n in link and link[0] != link[1] for link in links)}
    for most in (1 << 20, 10):
        monkeypatch.setattr(near_dedup, "_LINKS", most)
        assert {r.node: r.root for r in components(frame).collect()} == expected


def test_edges(spark):
    docs = edge_docs(spark)
    rows = as_rows(near_duplicates(docs))
    assert len(rows) == 12
    by_id = {row[0]: row[1:] for row in rows if row[0] is not None}
    assert by_id[1] == (4, 1, True)
    assert by_id[2] == (4, 1, False)
    assert by_id[3] == by_id[3][:0] + (0, 3, True)
    assert by_id[4] == (0, 4, True)
    assert by_id[5] == (0, 5, True)
    assert by_id[9] == (1, 9, True)
    assert [row[3] for row in rows if row[0] is None] == [True, True]
    assert near_duplicates(no_docs(spark)).collect() == []
    left = deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 3, 4, 5, 6, 8, 9, 10]


@pytest.mark.parametrize("slices", [1, 5])
def test_partitions_agree(spark, slices):
    docs = documents(spark)
    assert as_rows(near_duplicates(docs.repartition(slices))) == as_rows(near_duplicates(docs))


def test_pieces_meet_once_and_own_pieces_of_a_component_never(spark, monkeypatch):
    """Over all meetings, each two classes of different components that share a key are compared."""
    monkeypatch.setattr(near_dedup, "PIECE", 32)
    rng = np.random.default_rng(7)
    n, large = 300, 90
    keys = [sorted(rng.choice(6, rng.integers(1, 4), replace=False).tolist()) for _ in range(n)]
    crowd = Counter(k for own in keys for k in own)
    classes = spark.createDataFrame(
        [(i, 400, [i] * 8) for i in range(n)], "node bigint, n_shingles bigint, bits array<bigint>"
    )
    shared = "node bigint, score bigint, shared array<struct<band:bigint,crowd:bigint>>"
    crowded = spark.createDataFrame([(i, 1, [(k, crowd[k]) for k in own]) for i, own in enumerate(keys)], shared)
    roots = spark.createDataFrame([(i, 0) for i in range(large)], "node bigint, root bigint")
    root = lambda i: 0 if i < large else i
    met = near_dedup.meetings(crowded, classes, roots).collect()
    seen = Counter()
    for row in met:
        left, right = ([m["node"] for m in row[side]] for side in ("left", "right"))
        pairs = {(a, b) for a in left for b in right if root(a) != root(b)}
        seen.update({(max(p), min(p)) for p in pairs})
    expected = {(a, b) for a in range(n) for b in range(a) if root(a) != root(b) and set(keys[a]) & set(keys[b])}
    assert expected <= set(seen)
    assert set(seen.values()) == {1}
    # A piece that only the large component has doesn't meet itself.
    assert not any(row["within"] and {root(m["node"]) for m in row["left"]} == {0} for row in met)


def test_sets_are_compared_exactly(monkeypatch):
    monkeypatch.setattr(near_dedup, "_PART", 16)
    rng = np.random.default_rng(3)
    some = lambda: np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64))
    left, right = [some() for _ in range(40)], [some() for _ in range(30)]
    right[3], right[4] = left[5], left[6][: max(1, len(left[6]) * 3 // 4)]
    found = near_dedup.alike_sets(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            common = len(set(a.tolist()) & set(b.tolist()))
            assert found[i, j] == (100 * common >= 75 * (len(a) + len(b) - common))
    assert found[5, 3]


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    label = {i: i - i % 3 for i in range(60)}
    pairs = [tuple(p) for p in rng.integers(0, 60, (40, 2)).tolist()]
    kept = near_dedup.forest(iter(pairs), label)

    def groups(links):
        own = dict(label)
        for _ in range(60):
            for a, b in links:
                low = min(own[a], own[b])
                own = {i: low if top in (own[a], own[b]) else top for i, top in own.items()}
        return own

    assert groups(kept) == groups(pairs)
    assert len(kept) == 20 - len(set(groups(pairs).values()))


def test_mixtures_of_shared_passages(spark, monkeypatch):
    """Documents put together from one pool of passages: many share keys, some are linked."""
    monkeypatch.setattr(near_dedup, "PIECE", 48)
    rng = np.random.default_rng(11)
    rows = []
    for pool in range(3):
        passages = [" ".join(f"p{pool}w{rng.integers(1 << 30)}" for _ in range(40)) for _ in range(12)]
        for _ in range(200):
            chosen = np.sort(rng.choice(12, 8, replace=False))
            rows.append((len(rows), "\n".join(passages[i] for i in chosen) + f" x{rng.integers(1 << 30)}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    expected = plain_components(rows)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == expected
    assert 1 < sum(row[3] for row in expected) < len(rows)


def test_many_equal_rows(spark):
    rows = [(1, "a b c d e f g h i j")] * 500 + [(2, "a b c d e f g h i j k")] * 300 + [(3, "unlike all of the others here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    found = Counter(tuple(r) for r in near_duplicates(docs).collect())
    assert found == {(1, 6, 1, True): 500, (2, 7, 1, False): 300, (3, 2, 3, True): 1}
