import hashlib
import pickle
import random
import re

from ledgerline.llm.decontamination import build, contamination, decontaminated, find
from tests.llm.cases import MEDIUM, as_rows, documents, edge_docs, no_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(text, items, window=13):
    """Every window of every item at every place of the text."""
    words = words_of(text)
    hit, names = set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else ()
        for start in range(len(words) - size + 1) if own else ():
            if tuple(words[start : start + size]) in windows:
                hit.update(range(start, start + size))
                if name is not None:
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)


def test_documents(spark):
    docs = documents(spark, MEDIUM)
    items = spark.read.parquet(f"{MEDIUM}/benchmark.parquet")
    pairs = [(r.item_id, r.text) for r in items.collect()]
    expected = sorted((r.doc_id, *plain(r.text, pairs)) for r in docs.collect())
    whole = contamination(docs, items)
    assert as_rows(whole) == sorted(expected, key=repr)
    assert any(row[-1] for row in expected)
    kept = {r.doc_id for r in decontaminated(docs, items).collect()}
    assert kept == {row[0] for row in expected if not row[-1]}


def test_search_on_few_words():
    rng = random.Random(8)
    for _ in range(400):
        items = [(str(k), " ".join(rng.choices("ab", k=rng.randint(0, 6))).encode()) for k in range(4)]
        text = " ".join(rng.choices("abc", k=rng.randint(0, 30)))
        n, spans, names = find(text.encode(), build(items, window=4))
        hit = {i for a, b in zip(spans[::2], spans[1::2], strict=True) for i in range(a, b)}
        expected = plain(text, [(k, t.decode()) for k, t in items], window=4)
        assert (n, len(hit), len(names)) == expected[:3]


def test_long_windows_and_repeated_items():
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(40)]
    items = [(str(k), " ".join(rng.choices(pool, k=rng.choice([3, 13, 14, 60])))) for k in range(50)]
    items += [(f"again{k}", items[k][1].upper()) for k in range(25)] + [(None, items[3][1])]
    tables = build([(name, text.encode()) for name, text in items])
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(items)[1].split()
            start = rng.randrange(len(words))
            parts += words[start : start + rng.randint(1, 60)] + rng.choices(pool, k=rng.randint(0, 8))
        n, spans, names = find(" ".join(parts).encode(), tables)
        hit = {i for a, b in zip(spans[::2], spans[1::2], strict=True) for i in range(a, b)}
        expected = plain(" ".join(parts), items)
        assert (n, len(hit), len(names)) == expected[:3]
        assert hashlib.sha256(",".join(names).encode()).hexdigest() == expected[3]


def test_tables_are_compact():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(100_000)).encode()
    assert len(pickle.dumps(build([("1", text[: len(text) // 2]), ("2", text[len(text) // 2 :])]))) < 10 * len(text)


def test_pieces_give_the_same(spark):
    docs = edge_docs(spark).union(edge_docs(spark))
    names = "item_id bigint, text string"
    items = spark.createDataFrame(
        [
            (1, "delta epsilon zeta"), (2, "Alpha, BETA"), (3, None), (4, ""), (5, "..."), (None, "theta"),
            (6, "gamma delta"), (6, "gamma delta"), (7, "fox jumps over the lazy dog near 12 rivers the quick brown fox jumps"),
            (8, "文字"), (9, "cödé"),
        ],
        names,
    )
    pairs = [(r.item_id, r.text) for r in items.collect()]
    expected = sorted(((r.doc_id, *plain(r.text, pairs)) for r in docs.collect()), key=repr)
    assert as_rows(contamination(docs, items)) == expected
    assert as_rows(contamination(docs, items, piece_bytes=20)) == expected
    assert decontaminated(docs, items).columns == docs.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = contamination(edge_docs(spark), none).collect()
    assert len(rows) == 12 and not any(r.contaminated or r.n_hit for r in rows)
    assert contamination(no_docs(spark), none).collect() == []
