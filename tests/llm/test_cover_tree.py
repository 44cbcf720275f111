import math

import numpy as np
import pytest

from ledgerline.llm import cover_tree
from ledgerline.llm.cover_tree import Meeting, Tree, near_vectors
from tests.llm.cases import as_rows


def plain(rows, cosine=0.9):
    """Every pair of rows, in double precision."""
    width = max((len(v) for _, v in rows if v), default=0)
    usable = {}
    for k, (vec_id, v) in enumerate(rows):
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[k] = np.array(list(v) + [0.0] * (width - len(v)), np.float64)
    links = {k: [] for k in range(len(rows))}
    for i, x in usable.items():
        for j, y in usable.items():
            if i != j and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[i].append(j)
    out = []
    for k, (vec_id, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        least = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((vec_id, len(links[k]), least, vec_id is None or vec_id == least))
    return sorted(out, key=repr)


def frame_of(spark, rows, kind="float"):
    extra = [(*row, 1, 2, "x", 0.5) for row in rows]
    return spark.createDataFrame(extra, f"vec_id bigint, embedding array<{kind}>, label int, node bigint, x string, weight double")


def clusters(rng, sizes, spread, width=16):
    """Groups around random directions; within a group cosines lie about the threshold."""
    rows = []
    for size in sizes:
        centre = rng.normal(0, 1, width)
        centre /= np.linalg.norm(centre)
        rows += [(centre + rng.normal(0, spread, width)).astype(np.float32).astype(float).tolist() for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(i), rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("spread", [0.03, 0.08])
def test_groups_over_several_pieces(spark, monkeypatch, spread):
    monkeypatch.setattr(cover_tree, "LEAST_PIECE", 24)
    rng = np.random.default_rng(3)
    rows = clusters(rng, [150, 60, 30, *[3] * 30, *[1] * 60], spread)
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [rows[0]] * 3
    assert as_rows(near_vectors(frame_of(spark, rows).repartition(5), sample=60)) == plain(rows)


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
        (None, [1.0, 2.0]), (6, [0.0, 0.0]), (7, [2.0, 4.0]), (8, [1.0, 2.0, 0.0]), (9, [1e-200, 2e-200]),
        (10, [1.0]), (-3, [0.9, math.sqrt(0.19)]), (12, [1e150, 2e150]), (12, [-1.0, -2.0]), (11, [-0.0, 5.0]),
    ]
    found = as_rows(near_vectors(frame_of(spark, rows, "double")))
    # Squares of the smallest and largest would not fit; their directions do.
    scaled = [(i, [1.0, 2.0] if v and v[0] in (1e-200, 1e150) else v) for i, v in rows]
    assert found == plain(scaled)
    assert near_vectors(frame_of(spark, [])).collect() == []
    assert as_rows(near_vectors(frame_of(spark, [(4, None), (5, [0.0])]))) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_tree_covers_and_halves():
    rng = np.random.default_rng(5)
    raw = np.array([v for _, v in clusters(rng, [200, 50, *[4] * 20], 0.2, 6)])
    tree = Tree(np.arange(len(raw)), np.ones(len(raw), np.int64), raw).open()
    assert sorted(tree.ids.tolist()) == list(range(len(raw)))
    assert len(tree.levels[0][0]) == 1 and len(tree.levels[-1][0]) == len(raw)
    for number, (begins, reach) in enumerate(tree.levels):
        for node, (begin, far) in enumerate(zip(begins.tolist(), reach.tolist(), strict=True)):
            own = tree.points_of(number, node)
            distance = np.linalg.norm(tree.points[own] - tree.points[begin], axis=1).max()
            assert distance <= far + 1e-7
            if far > 0 and own.stop - own.start > cover_tree._LEAF:
                assert far <= 2.0 / 2**number + 1e-6
        # Nested: a level's centres are the next one's as well.
        assert set(begins.tolist()) <= set(tree.level(number + 1)[0].tolist())


def test_node_pairs_are_pruned():
    rng = np.random.default_rng(6)
    tight = np.array([v for _, v in clusters(rng, [100] * 20, 0.01)])
    tree = Tree(np.arange(2000), np.ones(2000, np.int64), tight).open()
    met = Meeting(tree, tree, 0.9)
    assert met.compared < 20_000  # of 1,999,000 pairs
    assert (met.counts == 99).all()
    halves = [Tree(np.arange(1000) + k, np.ones(1000, np.int64), tight[k : k + 1000]).open() for k in (0, 1000)]
    met = Meeting(*halves, 0.9)
    assert met.compared < 20_000 and len(np.unique(met.labels.label)) == 20
