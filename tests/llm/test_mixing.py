import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.mixing import mix, source_targets
from tests.llm.cases import MEDIUM, SMALL, as_rows, documents, edge_docs, no_docs


def plain_targets(sizes, weights=(1, 2, 3), share=1.0, cap=3):
    """Share out by weight, cap, share out the excess again, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    free, left = set(names), share * sum(sizes.values())
    while free and left > 1e-9:
        unit = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += unit * weight[s]
        left = sum(max(0.0, target[s] - cap * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_targets_and_taken_words(spark, folder):
    docs = documents(spark, folder)
    rows = mix(docs, keep=("source", "text")).collect()
    assert len(rows) == docs.count()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for row in rows:
        assert row.size == size_of(row.text)
        sizes[row.source] += row.size
        taken[row.source] += row.taken
        largest[row.source] = max(largest[row.source], row.size)
        assert row.taken == row.copies * row.size <= 3 * row.size
    target = plain_targets(sizes)
    for row in rows:
        assert row.target == pytest.approx(target[row.source])
        assert row.source_size == sizes[row.source]
    for source in sizes:
        gap = abs(target[source] - taken[source])
        # As near as half of the smallest document that could still be added.
        assert gap <= max(0.02 * target[source], 0.5 * largest[source]), (source, gap)
        left = [r["size"] for r in rows if r.source == source and r.copies < r.target / r.source_size]
        if taken[source] < target[source] - 1e-6:
            assert gap <= min((abs(gap - size) for size in left if size), default=gap) + 1e-6


def plain_mix(rows, target, rounds=3):
    """The order and the cut, one document after the other."""
    copies = {}
    by_source = defaultdict(list)
    for key, source, size, tie in rows:
        by_source[source].append((key, size, tie))
    for source, own in by_source.items():
        total = sum(size for _, size, _ in own)
        times = min(3.0, target[source] / total) if total else 0.0
        whole, chance = int(times), times - int(times)
        room = max(0.0, target[source] - whole * total)
        ranked = []
        for key, size, tie in own:
            copies[key] = whole
            u = ((tie % (1 << 64)) >> 11) + 0.5
            u /= 1 << 53
            q = (u / (1 - u)) / (chance / (1 - chance)) if chance else 0
            ranked.append((q, tie, size, key))
        drawn = set()
        for _ in range(rounds):
            most = room
            for _, _, size, key in sorted(ranked):
                if not chance or key in drawn or size > most:
                    continue
                if size > room:
                    break
                room -= size
                drawn.add(key)
                copies[key] += 1
        left = [(abs(s - room), q, tie, key) for q, tie, s, key in ranked if chance and key not in drawn and s]
        if left and min(left)[0] < room:
            copies[min(left)[-1]] += 1
    return copies


def test_order_is_pareto_sampling(spark):
    docs = documents(spark, MEDIUM)
    tied = docs.select("doc_id", "source", "text", F.xxhash64(F.lit(20), "doc_id", "source", "text").alias("tie"))
    rows = [(r.doc_id, r.source, size_of(r.text), r.tie) for r in tied.collect()]
    sizes = defaultdict(int)
    for _, source, size, _ in rows:
        sizes[source] += size
    expected = plain_mix(rows, plain_targets(sizes))
    found = {r.doc_id: r.copies for r in mix(docs).collect()}
    assert found == expected


def test_reruns_and_partitions_agree(spark):
    docs = documents(spark)
    rows = as_rows(mix(docs))
    assert as_rows(mix(docs.repartition(7))) == rows
    # Too many sources for a broadcast.
    assert as_rows(mix(docs, broadcast_bytes=0)) == rows


def test_targets_cover_caps_and_empty_sources(spark):
    sizes = {"a": 100, "b": 1, "c": 0, None: 50, "\U0001f600": 3, "￿": 2}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    for share in (0.5, 1.0, 2.9, 3.0, 4.0):
        rows = source_targets(frame, (1, 2, 3), share, 3).collect()
        expected = plain_targets(sizes, share=share)
        assert {r.source: r.target for r in rows} == pytest.approx(expected)


def test_odds_favour_documents(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.lit("a b c d").alias("text"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"),
    )
    rows = mix(docs, weights=(1,), share=0.5, odds=F.when(F.col("doc_id") < 2000, 3.0).otherwise(1.0)).collect()
    first = sum(r.copies for r in rows if r.doc_id < 2000)
    assert sum(r.taken for r in rows) == 8000
    assert 0.70 < first / 2000 < 0.80


def test_edges(spark):
    rows = mix(edge_docs(spark)).collect()
    assert len(rows) == 12
    assert {r.taken for r in rows if r["size"] == 0} == {0}
    assert mix(no_docs(spark)).collect() == []


def test_equal_rows_are_taken_one_by_one(spark):
    """A source of equal rows, and a third of all rows equal, come near their targets."""
    rows = [(1, "a b c d", "a")] * 600 + [(None, None, "b")] * 300
    rows += [(10 + i, " ".join(["w"] * (1 + i % 5)), "bc"[i % 2]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    found = mix(docs).collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for row in found:
        assert row.taken <= 3 * row.size
        taken[row.target] += row.taken
    assert len(taken) == 3
    assert all(abs(words - target) <= 5 for target, words in taken.items())
    with_texts = mix(docs.repartition(3), keep=("text", "source")).collect()
    again = defaultdict(int)
    for row in with_texts:
        again[row.source] += row.taken
    assert sorted(again.values()) == sorted(taken.values())
    tie = lambda row: (row.doc_id or 0, row.size, row.taken)
    assert sorted(map(tie, mix(docs.repartition(2)).collect())) == sorted(map(tie, found))
