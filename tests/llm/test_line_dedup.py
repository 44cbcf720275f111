import hashlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import queries
from ledgerline.llm.line_dedup import WHOLE, drop_lines, line_report, without_lines
from tests.llm.cases import MEDIUM, as_rows, documents, edge_docs, no_docs


def plain_patterns(lines, least):
    """Of lines (words -> text, document) those of recurring patterns: words -> smallest document."""
    leaves = defaultdict(list)
    for words, (text, doc_id) in lines.items():
        n = len(words)
        parts = [[] for _ in range(8)]
        for p, word in enumerate(words):
            parts[p * 8 // n].append("<*>" if any(c in "0123456789" for c in word) else word)
        for closed in combinations(range(4), 3 if n < 8 else 2):
            own = tuple(tuple(parts[k]) for c in closed for k in (2 * c, 2 * c + 1))
            leaves[n, closed, own].append((words, text, doc_id, parts))
    patterns = defaultdict(list)
    for leaf, members in leaves.items():
        if len({text for _, text, _, _ in members}) < least:
            continue
        holders = defaultdict(set)
        for _, text, _, parts in members:
            for k, part in enumerate(parts):
                if part and set(part) != {"<*>"}:
                    holders[k, tuple(part)].add(text)
        for words, text, doc_id, parts in members:
            kept = tuple((k, tuple(p)) for k, p in enumerate(parts) if len(holders.get((k, tuple(p)), ())) >= least)
            if len(kept) >= 0.6 * sum(map(bool, parts)):
                patterns[leaf, kept].append((words, text, doc_id))
    recurring = {p: own for p, own in patterns.items() if len({text for _, text, _ in own}) >= least}
    best = defaultdict(list)
    for pattern, own in recurring.items():
        for words, _, doc_id in own:
            best[words].append((len(pattern[1]), len({text for _, text, _ in own}), pattern, doc_id))
    chosen = {words: max(some, key=lambda s: s[:2]) for words, some in best.items()}
    # Ties between patterns are broken by hashes; tests have none that matter.
    firsts = {}
    for _, _, pattern, doc_id in chosen.values():
        if doc_id is not None:
            firsts[pattern] = min(firsts.get(pattern, doc_id), doc_id)
    return {words: firsts.get(pattern) for words, (_, _, pattern, _) in chosen.items()}


def plain(spark, rows, min_texts=2, min_words=4, short_texts=None, pattern_texts=20):
    frame = spark.createDataFrame([(text,) for _, text in rows], "text string")
    digests = {r.text: r.d for r in frame.select("text", F.xxhash64("text").alias("d")).distinct().collect()}
    texts, first = defaultdict(set), {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            words = tuple(line.encode().split())
            texts[words].add(text)
            if doc_id is not None:
                first[words] = min(first.get(words, doc_id), doc_id)
    recurring = {}
    for words, own in texts.items():
        least = min_texts if len(words) >= min_words else short_texts
        if words and least is not None and len(own) >= least:
            recurring[words] = first.get(words)
    whole = {
        tuple(w.decode() for w in words): (min(own, key=digests.get), first.get(words))
        for words, own in texts.items()
        if len(words) >= max(4, min_words)
    }
    for words, doc_id in plain_patterns(whole, pattern_texts).items():
        recurring[tuple(w.encode() for w in words)] = doc_id
    out = []
    for doc_id, text in rows:
        if text is None:
            out.append((doc_id, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [ln for ln in lines if recurring.get(w := tuple(ln.encode().split()), doc_id) == doc_id or (not w)]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=repr)


def test_documents(spark):
    docs = documents(spark, MEDIUM)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for options in (WHOLE, {"min_texts": 2, "pattern_texts": 3}):
        expected = plain(spark, rows, **options)
        assert as_rows(line_report(docs, **options)) == expected
        assert any(row[2] for row in expected)


def table(spark, texts):
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


NAMES = ["".join(chr(97 + (7 * i + 3 * k) % 26) for k in range(5)) + "xyz"[i // 26] for i in range(30)]


def test_fields_anywhere_are_learnt(spark):
    """A field at the end of a short line, the first word, and two fields."""
    shapes = [
        lambda x, y: f"Posted by user {x}",
        lambda x, y: f"{x} wrote on the forum about gardens and trees",
        lambda x, y: f"Seen by {x} in the northern garden of {y} on the evening before last",
        lambda x, y: f"Order {x} of {len(x) * 37} pieces was sent",
    ]
    texts = []
    for i, name in enumerate(NAMES):
        other = NAMES[(i * 7 + 3) % 30] + "z"
        own = " ".join(f"{name}{other[k:]}{k * 'x'}" for k in range(5 + i % 3))
        texts.append("\n".join([own, *(shape(name, other) for shape in shapes)]))
    docs = table(spark, texts)
    rows = {r.doc["doc_id"]: r.left for r in drop_lines(docs, **WHOLE).collect()}
    assert rows[0]["text"] == texts[0]
    assert all(rows[i]["text"] == texts[i].split("\n")[0] for i in range(1, 30))
    assert as_rows(line_report(docs, **WHOLE)) == plain(spark, list(enumerate(texts)), **WHOLE)


def test_number_rows_and_seldom_patterns_stay(spark):
    texts = [f"{i} {i * 3} {i * 7}.5 {i}%\nseldom met pattern of {NAMES[i]} here" for i in range(19)]
    texts += [f"{i} 2 3 4\n{i} {i} 2024-01-{i}" for i in range(20, 60)]
    docs = table(spark, texts)
    assert {r.n_dropped for r in line_report(docs, **WHOLE).collect()} == {0}
    assert {r.n_dropped for r in line_report(docs, min_texts=2, pattern_texts=19).collect()} == {0, 1}


def test_random_lines_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = ["\n".join(" ".join(rng.choice(list("abcd1"), rng.integers(1, 13))) for _ in range(6)) for _ in range(60)]
    rows = list(enumerate(texts))
    found = line_report(table(spark, texts), min_texts=2, pattern_texts=8, short_texts=4)
    expected = plain(spark, rows, min_texts=2, pattern_texts=8, short_texts=4)
    # Ties between patterns of a line may fall either way here.
    agree = sum(a[:3] == b[:3] for a, b in zip(as_rows(found), expected, strict=True))
    assert agree >= 50


def test_many_equal_rows(spark):
    text = "a line of five words\nanother line of five words\nfoot of the page"
    rows = [(1, text)] * 400 + [(None, text)] * 400 + [(2, "a line of five words\nelse")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_report(docs, **WHOLE).collect()}
    assert found == {(1, 3, 0), (None, 3, 1), (2, 2, 1)}


def test_exact_copies_are_no_boilerplate(spark):
    docs = table(spark, ["one two three four five six seven eight nine\nten eleven twelve thirteen"] * 50)
    assert {r.n_dropped for r in line_report(docs).collect()} == {0}


def test_long_passage_in_other_documents_goes(spark):
    passage = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [f"unlike opening words {chr(97 + i) * 5} here\n{passage}" for i in range(6)]
    kept = [r.text for r in without_lines(table(spark, texts), **WHOLE).orderBy("doc_id").collect()]
    assert [passage in text for text in kept] == [True] + [False] * 5


def test_documents_left_empty_go_and_counts_follow(spark):
    line = "the same footer line on every single page"
    docs = table(spark, [f"{line}\nmore of page {chr(97 + i) * 3} alone" for i in range(5)] + [line, ""])
    rows = {r.doc_id: r for r in without_lines(docs).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 6]
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert without_lines(docs).columns == docs.columns


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for min_texts in (1, 2, 5):
        assert as_rows(line_report(docs, min_texts=min_texts)) == plain(spark, rows, min_texts)
    assert as_rows(line_report(docs, **WHOLE)) == plain(spark, rows, **WHOLE)
    assert without_lines(docs).count() == 12
    assert without_lines(docs).columns == docs.columns
    assert line_report(no_docs(spark)).collect() == []


def test_registered_query_drops_every_repeat(spark, tmp_path):
    own = [" ".join(f"{chr(97 + i) * 4}{k * 'y'}" for k in range(7)) for i in range(20)]
    texts = [f"{line}\nLes." for line in own]
    texts[3] += "\na line that stands in two texts"
    texts[7] += "\na line that stands in two texts\nSeldom."
    texts[9] += "\nSeldom."
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.n_dropped for r in queries.QUERIES["op9_pattern_tree"](spark, str(tmp_path)).collect()}
    assert rows == {0: 0, 7: 2} | {i: 1 for i in range(1, 20) if i != 7}
