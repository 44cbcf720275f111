import hashlib
from collections import defaultdict

import corpus_pipeline
from ledgerline.llm import decontamination, language_id, near_dedup
from ledgerline.llm.line_dedup import WHOLE
from tests.llm import test_decontamination, test_line_dedup, test_mixing, test_near_dedup
from tests.llm.cases import MEDIUM, SMALL, documents, edge_docs, no_docs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark):
    docs = documents(spark, MEDIUM)
    items = spark.read.parquet(f"{MEDIUM}/benchmark.parquet")
    everything = {r.doc_id for r in docs.collect()}
    seen = [everything]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(MEDIUM)).cache()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        assert set(ids) <= seen[-1]
        seen.append(set(ids))
        if name != "mixing":
            assert docs.columns == COLUMNS
        if name == "language":
            assert set(ids) == everything
        if name == "lines":
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "near duplicates":
            assert near_dedup.near_duplicates(docs).where("not kept").count() == 0
        if name == "benchmark":
            assert decontamination.contamination(docs, items).where("contaminated").count() == 0
    assert len(seen[3]) < len(seen[2])
    assert len(seen[4]) < len(seen[3])
    assert docs.where("copies < 1 or taken > 3 * size").count() == 0


def test_run_writes_and_rereads(spark):
    rows = corpus_pipeline.run(spark, str(MEDIUM.parent / "sf0.001"))
    assert rows.count() > 0
    assert {"doc_id", "text", "copies", "taken", "target"} <= set(rows.columns)


def test_awkward_documents_pass_every_stage(spark):
    folder = str(MEDIUM.parent / "sf0.001")
    for docs in (edge_docs(spark), no_docs(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            rows = docs.collect()
            assert name == "mixing" or docs.columns == columns
        assert all(r.copies >= 1 for r in rows)


def test_stages_equal_brute_force(spark):
    """Each stage against a plain version of it, on what its predecessor kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark).repartition(4)

    def after(name):
        kept = stages[name](spark, docs, str(SMALL)).cache()
        return kept, {r.doc_id: r for r in kept.collect()}, [(r.doc_id, r.text) for r in docs.collect()]

    kept, found, rows = after("language")
    model = language_id.fit(docs.where(language_id.learns()))
    verdicts = zip(rows, model.predict([text for _, text in rows]), strict=True)
    assert set(found) == {doc_id for (doc_id, _), (_, _, rejected) in verdicts if not rejected}

    docs = kept
    kept, found, rows = after("lines")
    for doc_id, _, n_dropped, digest in test_line_dedup.plain(spark, rows, **WHOLE):
        if doc_id in found:
            assert hashlib.sha256(found[doc_id].text.encode()).hexdigest() == digest
        else:
            assert n_dropped > 0
    assert len(found) > 0.8 * len(rows)

    docs = kept
    kept, found, rows = after("near duplicates")
    assert set(found) == {row[0] for row in test_near_dedup.plain_components(rows) if row[3]}

    docs = kept
    kept, found, rows = after("benchmark")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(found) == {doc_id for doc_id, text in rows if not test_decontamination.plain(text, items)[-1]}

    docs = kept
    sources = {r.doc_id: r.source for r in docs.collect()}
    kept, found, rows = after("mixing")
    sizes, taken = defaultdict(int), defaultdict(int)
    for doc_id, text in rows:
        sizes[sources[doc_id]] += test_mixing.size_of(text)
    for row in found.values():
        taken[row.source] += row.taken
    target = test_mixing.plain_targets(sizes)
    largest = max(test_mixing.size_of(text) for _, text in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes)
