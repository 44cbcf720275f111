import hashlib
import zlib
from collections import defaultdict

import numpy as np

from ledgerline.llm import prefix_trie as module
from ledgerline.llm.prefix_trie import hashes_agree, prefix_trie
from tests.llm.cases import MEDIUM, as_rows


def plain(rows):
    """The trie of rebuilt conversations, with their texts put together."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt = tuple(own.get(base, [])[:h] + turns[h:])
        for depth in range(len(rebuilt) + 1):
            nodes[rebuilt[:depth]].append(c)
        ends[rebuilt].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node])
        saved[node] += (len(nodes[node]) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            (
                min(members),
                len(node),
                min(nodes[node[:-1]]) if node else None,
                len(members),
                len(children[node]),
                leaves[node],
                saved[node],
                hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
            )
            for node, members in nodes.items()
        ),
        key=repr,
    )


def table(spark, rows):
    extra = [(*row, 7, "x") for row in rows]
    return spark.createDataFrame(extra, "conv_id bigint, turn bigint, role string, text string, size bigint, node string")


def test_conversations(spark):
    frame = spark.read.parquet(f"{MEDIUM}/conversations.parquet").where("conv_id < 60")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()]
    assert as_rows(prefix_trie(frame.repartition(6))) == plain(rows)


def test_shared_turns_and_long_conversations(spark, monkeypatch):
    """A third of all turns in one conversation, a third of all conversations equal, few different turns."""
    monkeypatch.setattr(module, "PIECE", 4)
    rng = np.random.default_rng(4)
    rows = [(100, i, "user", "ab"[int(rng.integers(2))]) for i in range(200)]
    for c in range(200, 330):
        equal = c % 3 == 0
        rows += [(c, i, "user", "same" if equal else "abc"[int(rng.integers(3))]) for i in range(4 if equal else int(rng.integers(1, 6)))]
    assert as_rows(prefix_trie(table(spark, rows).repartition(5))) == plain(rows)


def test_awkward_turns(spark):
    rows = [
        (0, 2, "user", "two"), (0, None, None, None), (0, 1, "user", "Ünï \U0001f600"), (0, 1, "user", "Ünï \U0001f600"),
        (0, 1, "user", "other at the same place"), (None, 0, "user", "nobody's"), (1, 0, None, ""), (1, 5, "", None),
        (2, 0, "us", "er text"), (3, 0, "user", " text"), (4, 0, "user", "x" * 100_000), (-5, 0, "a", "b"), (-5, 1, "a", "c"),
        (-205, 3, "a", "c"), (57, 0, "q", "one turn only"), (1057, 0, "no base", "t"), (1058, 0, "no base", "t"),
    ]
    rows += [(c, 0, "user", "two") for c in range(10, 40)]
    assert as_rows(prefix_trie(table(spark, rows))) == plain(rows)
    assert prefix_trie(table(spark, [])).collect() == []
    assert prefix_trie(table(spark, [(None, 1, "a", "b")])).collect() == []


def test_unequal_turns_of_equal_hashes_are_seen(spark, monkeypatch):
    frame = table(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a")])
    assert hashes_agree(frame, 13)
    monkeypatch.setattr(module, "PRIMES", (2, 2, 2, 2))
    assert not hashes_agree(frame, 13)
