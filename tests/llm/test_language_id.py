import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm.language_id import BITS, UNKNOWN, fit, has_letter, identified, identify, learns, predict_languages
from tests.llm.cases import MEDIUM, as_rows, documents, edge_docs, no_docs


def test_held_out_accuracy(spark):
    docs = documents(spark, MEDIUM)
    langs = {r.doc_id: r.lang for r in docs.collect()}
    rows = predict_languages(docs).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # Texts like those learnt from are not turned away.
    assert not any(r.rejected for r in rows)


def test_labels_of_predicted_rows_do_not_matter(spark):
    docs = documents(spark)
    blind = docs.withColumn("lang", F.when(learns(), F.col("lang")).otherwise("zz")).withColumn("source", F.lit("q"))
    assert as_rows(predict_languages(docs)) == as_rows(predict_languages(blind))


def test_partitions_agree(spark):
    docs = documents(spark)
    names = lambda frame: sorted((r.doc_id, r.lang_pred, r.rejected) for r in frame.collect())
    assert names(predict_languages(docs.repartition(5))) == names(predict_languages(docs))


def test_other_scripts_are_rejected(spark):
    docs = documents(spark, MEDIUM)
    model = fit(docs.where(learns()))
    strange = spark.createDataFrame(
        [(1, "мама мыла раму а папа читал газету"), (2, "文字化けの例文です"), (3, "the end of the thing and that is on"), (4, "12 - 7")],
        "doc_id bigint, text string",
    )
    rejected = {r.doc["doc_id"]: r.found["rejected"] for r in identify(strange, model).collect()}
    assert rejected == {1: True, 2: True, 3: False, 4: True}


def test_sample_is_bounded(spark):
    docs = documents(spark, MEDIUM)
    some = fit(docs, fit_rows=60)
    assert sorted(set(some.languages)) == ["de", "en", "es", "fr"]
    same = docs.withColumn("doc_id", F.lit(5))
    assert fit(same, fit_rows=30).centroids.shape[0] <= 12


def test_edges(spark):
    docs = edge_docs(spark)
    rows = predict_languages(docs).collect()
    assert len(rows) == 12
    for text, row in zip([r.text for r in docs.collect()], rows, strict=True):
        assert (row.lang_pred == UNKNOWN) == (not has_letter(text))
        assert row.lang_pred == UNKNOWN or row.lang_pred in ("en", "de", "xx")
        assert row.score == 0.0 or row.lang_pred != UNKNOWN
    assert predict_languages(no_docs(spark)).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in predict_languages(unlabelled).collect()} == {UNKNOWN}
    assert identified(docs).columns == docs.columns


def test_unlearnt_latin_languages_and_junk_are_rejected(spark):
    docs = documents(spark, MEDIUM)
    model = fit(docs.where(learns()))
    strange = [
        "wszyscy ludzie rodza sie wolni i rowni pod wzgledem swej godnosci i swych praw sa oni obdarzeni rozumem",
        "tutti gli esseri umani nascono liberi ed eguali in dignita e diritti essi sono dotati di ragione",
        "kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki",
        "butun insanlar hur haysiyet ve haklar bakimindan esit dogarlar akil ve vicdana sahiptirler",
        "watu wote wamezaliwa huru hadhi na haki zao ni sawa wote wamejaliwa akili na dhamiri",
    ]
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    strange += [" ".join(letters(rng.integers(2, 9)) for _ in range(n)) for n in (5, 20, 100, 1000)]
    assert [rejected for _, _, rejected in model.predict(strange)] == [True] * len(strange)
    held = [r.text for r in docs.where(~learns() & F.col("text").isNotNull()).collect()]
    openings = [" ".join(text.split()[:n]) for text in held for n in (3, 6, 12)]
    clean = [text for text in held + openings if has_letter(text)]
    assert np.mean([rejected for _, _, rejected in model.predict(clean)]) < 0.002


def plain_grams(text):
    """Weights of hashed byte n-grams, from dictionaries."""
    line = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} ".encode()
    counts = Counter()
    for n, multiplier in ((2, 0x9E3779B1), (3, 0x85EBCA6B), (4, 0xC2B2AE35)):
        for i in range(len(line) - n + 1):
            code = int.from_bytes(line[i : i + n], "big") * multiplier % (1 << 32)
            counts[code >> (32 - BITS)] += 1
    return counts


def plain_centroids(texts, k, turns=12):
    """Dense k-means over all texts of each language, which is small."""
    grams = [plain_grams(text) for _, text in texts]
    seen = Counter(g for own in grams for g in own)
    rows = np.zeros((len(texts), 1 << BITS))
    for row, own in zip(rows, grams, strict=True):
        for g, n in own.items():
            row[g] = (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + seen[g])) + 1)
        row /= np.linalg.norm(row)
    out = {}
    for lang in sorted({lang for lang, _ in texts}):
        own = rows[[i for i, (name, _) in enumerate(texts) if name == lang]]
        centres = [own[(own @ own.mean(0)).argmax()]]
        while len(centres) < min(k, len(own)):
            centres.append(own[np.max([own @ c for c in centres], 0).argmin()])
        for _ in range(turns):
            nearest = np.argmax([own @ c for c in centres], 0)
            sums = [own[nearest == j].sum(0) for j in range(len(centres)) if (nearest == j).any()]
            centres = [s / np.linalg.norm(s) for s in sums]
        out[lang] = np.array(centres)
    return out, rows


def test_centroids_and_predictions_equal_brute_force(spark):
    docs = documents(spark).where(F.col("n_chars") > 40)
    model = fit(docs)
    order = docs.select("lang", "text", F.pmod(F.xxhash64(F.lit(10), "doc_id", "text"), F.lit(1 << 40)).alias("s"))
    texts = [(r.lang, r.text) for r in sorted(order.collect(), key=lambda r: r.s)]
    expected, rows = plain_centroids(texts, 3)
    names = [lang for lang, own in expected.items() for _ in own]
    stacked = np.concatenate(list(expected.values()))
    assert model.languages == names
    assert np.allclose(model.centroids, stacked, atol=1e-5)
    similar = rows @ stacked.T
    found = model.predict([text for _, text in texts])
    assert np.allclose([score for _, score, _ in found], similar.max(1), atol=1e-5)
    assert np.mean([a == names[j] for (a, _, _), j in zip(found, similar.argmax(1), strict=True)]) > 0.995


def test_one_language_many_languages_and_long_texts(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(c) for c in rng.integers(97, 123, 6))
    vocabularies = [[word() for _ in range(20)] for _ in range(100)]
    rows = [(i, " ".join(rng.choice(vocabularies[i % 100], 30)), f"l{i % 100}") for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit(many)
    assert len(set(model.languages)) == 100
    assert np.mean([p[0] == lang for p, (_, _, lang) in zip(model.predict([r[1] for r in rows]), rows, strict=True)]) > 0.99
    # More languages than rows are wanted: each still has some chance of being learnt.
    assert 1 <= len(set(fit(many, fit_rows=10).languages)) <= 100
    long = [(i, " ".join(rng.choice(vocabularies[0], 15_000)), "one") for i in range(6)]
    one = fit(spark.createDataFrame(long * 3, "doc_id bigint, text string, lang string"))
    assert set(one.languages) == {"one"} and len(one.languages) <= 3
