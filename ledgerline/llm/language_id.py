"""Language identification by nearest centroids.

A text becomes a vector of hashed n-grams of its letters' bytes (two, three
and four at a time, words set apart by blanks), weighted by log frequency
and inverse document frequency and brought to length one. Each language has
several centroids, found by spherical k-means over labelled texts; a text
gets the language of the nearest by cosine.

A text much further from its language than that language's own texts of its
length is rejected. Similarity grows with length, so limits are set by
language and number of different n-grams, doubling from band to band: a
quarter of the sample, and its first 1, 2, 4, ... words as short texts, are
compared with centroids of the other three quarters. A band with too few of
them has the limit of the next shorter one, or none.

The model is fitted on a sample of labelled rows, whole texts, of about
`FIT_ROWS` rows: from each language those whose hash is below the share that
its row count allows. Texts become n-grams where they are read. A task per
language then clusters its part of the sample as sparse rows, of at most
32,768 n-grams whatever the length of a text; dense are only the centroids.
The driver sees how many texts hold each n-gram, and the centroids: 384 kB a
language.

Defined results: texts that are null or hold no letter are `und` with score
0 and count as rejected; with no labelled text every text is `und`; equal
texts get equal results; repeated rows are learnt from once and each get
theirs; columns of `docs`, whatever their names, come back untouched in the
struct `doc`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_BYTES, cut, ship

UNKNOWN = "und"
BITS = 15
FIT_ROWS = 2_000
CENTROIDS = 3
#: Rejected below this share of the similarity that all but one in a hundred
#: of a language's own texts of that length reach.
REJECT, LEAST_QUANTILE = 1 / 3, 0.01
#: Bands of n-gram counts, texts that set a band's limit at least, and words of short ones.
LENGTHS, TRIALS, OPENINGS = 24, 20, (1, 2, 4, 8, 16, 32, 64, 128, 256)

#: Texts a worker holds at once, and parts of the sample.
_AT_ONCE, _PARTS = 256, 16
_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
_RESULT = "lang_pred string, score double, rejected boolean"
_SAMPLE = "lang string, spread bigint, opening int, trial boolean, grams binary, counts binary"
_LEARNT = "lang string, number int, centre binary, least array<double>"

#: Cells and weights of the n-grams that a text holds, of length one.
Sparse = tuple[np.ndarray, np.ndarray]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs."""
    line = f" {' '.join(_WORD.findall(text.lower()))} ".encode()
    b = np.frombuffer(line, np.uint8).astype(np.uint32)
    codes = []
    gram = b
    for n, multiplier in zip((2, 3, 4), _MULTIPLIERS, strict=True):
        if len(b) < n:
            break
        gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
        codes.append((gram * np.uint32(multiplier)) >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(codes) if codes else [], minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def vector(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> Sparse:
    weights = (1 + np.log(counts)).astype(np.float32) * idf[found]
    return found, weights / max(float(np.linalg.norm(weights)), 1e-30)


@dataclass
class Model:
    """Centroids of all languages, and the least similarity each accepts in each band of lengths."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def __post_init__(self):
        self.columns = np.ascontiguousarray(self.centroids.T)

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "columns"}

    def __setstate__(self, state):
        vars(self).update(state)
        self.__post_init__()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for text in texts:
            if not (self.languages and has_letter(text)):
                out.append((UNKNOWN, 0.0, True))
                continue
            found, weights = vector(*ngrams(text), self.idf)
            similar = weights @ self.columns[found]
            best = int(similar.argmax())
            score = min(1.0, max(0.0, float(similar[best])))
            out.append((self.languages[best], score, bool(score < self.least[best, _band(len(found))])))
        return out


def _clusters(rows: list[Sparse], k: int, turns: int = 12) -> np.ndarray:
    """Spherical k-means. Starts from the mean's nearest row, then the rows furthest from all."""

    def added(some: list[Sparse]) -> np.ndarray:
        total = np.zeros(1 << BITS)
        for found, weights in some:
            total[found] += weights
        return total

    def similar(centre: np.ndarray) -> np.ndarray:
        return np.array([weights @ centre[found] for found, weights in rows])

    chosen = [int(similar(added(rows)).argmax())]
    near = similar(added([rows[chosen[0]]]))
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, similar(added([rows[chosen[-1]]])))
    centres = np.stack([added([rows[i]]) for i in chosen])
    for _ in range(turns):
        nearest = np.stack([similar(centre) for centre in centres]).argmax(0)
        sums = [added([row for row, own in zip(rows, nearest, strict=True) if own == j]) for j in np.unique(nearest)]
        centres = np.stack([s / max(float(np.linalg.norm(s)), 1e-30) for s in sums])
    return centres.astype(np.float32)


def _band(grams: int) -> int:
    return min(max(grams, 1).bit_length() - 1, LENGTHS - 1)


def _limits(centres: np.ndarray, trials: list[Sparse]) -> list[float]:
    """The least similarity accepted in each band of lengths."""
    met: dict[int, list[float]] = {}
    for found, weights in trials:
        met.setdefault(_band(len(found)), []).append(float((centres[:, found] @ weights).max()))
    limits, limit = [], 0.0
    for band in range(LENGTHS):
        if len(met.get(band, ())) >= TRIALS:
            limit = REJECT * float(np.quantile(met[band], LEAST_QUANTILE))
        limits.append(limit)
    return limits


def _cells(grams: bytes) -> np.ndarray:
    return np.frombuffer(grams, "<u2").astype(np.int64)


def _trained(idf, k: int):
    """Centroids and limits of one language, from its part of the sample."""

    def trained(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["spread", "opening"], kind="stable")
        rows = [
            vector(_cells(grams), np.frombuffer(counts, "<u4"), idf.value)
            for grams, counts in zip(frame.pop("grams"), frame.pop("counts"), strict=True)
        ]
        whole, trial = frame["opening"].to_numpy() == 0, frame["trial"].to_numpy()
        pick = lambda mask: [rows[i] for i in np.flatnonzero(mask)]
        learnt = pick(whole & ~trial)
        limits = _limits(_clusters(learnt, k), pick(trial)) if learnt else [0.0] * LENGTHS
        centres = _clusters(pick(whole), k) if whole.any() else np.zeros((0, 1 << BITS), np.float32)
        out = [(key[0], number, centre.tobytes(), limits) for number, centre in enumerate(centres)]
        return pd.DataFrame(out, columns=["lang", "number", "centre", "least"])

    return trained


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of sample texts, and of the openings of those that set limits."""
    for batch in batches:
        for lang, text, at in zip(*(batch.column(c) for c in ("lang", "text", "spread")), strict=True):
            lang, text, at = lang.as_py(), text.as_py(), at.as_py()
            trial = at % 4 == 0
            words = text.split(None, max(OPENINGS))[: max(OPENINGS)] if trial else []
            openings = [(n, " ".join(words[:n])) for n in OPENINGS if n < len(words)]
            rows = [(n, *ngrams(part)) for n, part in [(0, text), *openings] if has_letter(part)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(rows), pa.string()),
                    pa.array([at] * len(rows), pa.int64()),
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([trial] * len(rows), pa.bool_()),
                    pa.array([r[1].astype("<u2").tobytes() for r in rows], pa.binary()),
                    pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
                ],
                ["lang", "spread", "opening", "trial", "grams", "counts"],
            )


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a part's texts there are, and how many hold each n-gram."""
    texts, seen = 0, np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for grams in batch.column("grams"):
            texts += 1
            seen[_cells(grams.as_py())] += 1
    yield pa.RecordBatch.from_arrays([pa.array([texts]), pa.array([seen.tobytes()], pa.binary())], ["texts", "seen"])


def sampled(labelled: DataFrame, fit_rows: int) -> DataFrame:
    """lang, text and spread of about `fit_rows` labelled rows, as many from each language."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = cut(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    n, most = sizes.agg(F.count("*"), F.sum(F.octet_length("lang") + 32)).first()
    per_language = max(1, fit_rows // max(1, n))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    shares = sizes.select(F.col("lang").alias("named"), F.ceil(share * float(1 << 40)).alias("share"))
    if (most or 0) < BROADCAST_BYTES:
        shares = F.broadcast(shares)
    spread = F.pmod(F.xxhash64(F.lit(10), "doc_id", "text"), F.lit(1 << 40))
    rows = labelled.select("lang", "text", spread.alias("spread"))
    rows = rows.join(shares, F.col("lang") == F.col("named")).where(F.col("spread") < F.col("share"))
    # Equal rows have one hash, however often they occur.
    rows = rows.groupBy("lang", "spread").agg(F.min("text").alias("text"))
    return rows.repartition(_PARTS, "spread")


def fit(labelled: DataFrame, *, fit_rows: int = FIT_ROWS, k: int = CENTROIDS) -> Model:
    """Train on rows of doc_id, text and lang, a bounded sample of them."""
    ship(labelled.sparkSession)
    rows = cut(sampled(labelled, fit_rows).mapInArrow(_featured, _SAMPLE))
    texts, seen = 0, np.zeros(1 << BITS)
    for part in rows.where(F.col("opening") == 0).select("grams").mapInArrow(_held, "texts bigint, seen binary").collect():
        texts += part["texts"]
        seen += np.frombuffer(part["seen"], np.int64)
    idf = (np.log((1 + texts) / (1 + seen)) + 1).astype(np.float32)
    shared = labelled.sparkSession.sparkContext.broadcast(idf)
    learnt = rows.groupBy("lang").applyInPandas(_trained(shared, k), _LEARNT).collect()
    learnt.sort(key=lambda r: (r["lang"], r["number"]))
    centroids = np.zeros((len(learnt), 1 << BITS), np.float32)
    for row, part in zip(centroids, learnt, strict=True):
        row[:] = np.frombuffer(part["centre"], np.float32)
    least = np.array([part["least"] for part in learnt]).reshape(-1, LENGTHS)
    return Model(idf, centroids, [part["lang"] for part in learnt], least)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Columns `doc` (the given row) and `found` (lang_pred, score, rejected)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, kinds = ["lang_pred", "score", "rejected"], [pa.string(), pa.float64(), pa.bool_()]
        for texts in batches:
            rows = []
            for first in range(0, len(texts), _AT_ONCE):
                rows += shared.value.predict(texts.slice(first, _AT_ONCE).to_pylist())
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.StructArray.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names
            )

    rows = docs.select(F.struct("*").alias("doc"))
    return rows.select("doc", predicted(F.col("doc.text")).alias("found"))


def learns(doc_id: str = "doc_id", folds: int = 3, held: int = 1) -> Column:
    """Whether a row is for learning; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds != held, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    model = fit(docs.where(learns()))
    held = F.coalesce(F.crc32(F.col("doc.doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identify(docs, model).select("doc.doc_id", held.alias("held_out"), "found.*")


def identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    return identify(docs, fit(docs.where(learns()))).where(~F.col("found.rejected")).select("doc.*")
