"""Language-model scores by a weighted backoff automaton.

The model counts n-grams of whole training texts. An n-gram's probability
is its count smoothed by the next shorter one's (a Dirichlet prior of
strength `prior`):

    P(w | h) = (c(hw) + prior * P(w | h')) / (c(h) + prior)

down to P(w) = (c(w) + 1) / (N + V + 1). Histories that were seen are
states. A seen n-gram is an arc, weighted with its log-probability; the
failure arc of a state leads to its shorter history and weighs
log(prior / (c(h) + prior)). A text is read once from left to right: the
automaton carries its state, takes failure arcs until the state has an arc
for the word, and adds up the weights.

The automaton of a large corpus is too large to broadcast, and a text needs
little of it. Texts are put into blocks of about 4 MB, runs of rows as they
are read, stored as tokens. A block asks twice for counts, and brings along how
often its own training texts hold what it asks for. First it asks for its
distinct words, by hash; the answer also numbers each word. Then it asks for
its distinct longer n-grams, as a trie of word numbers cut by the first two
words. Both go out in a row for each of the buckets that the words, or pairs
of words, are spread over. A bucket adds up the blocks' counts and answers
each block in the order it asked. What follows a pair of very frequent words is
dealt over several buckets by the third word. So an n-gram, however frequent, crosses the
network once per block. The block then builds its part of the automaton and
reads its texts. There an arc is found by the n-gram that a state's history
and the word make, and a state by the history it stands for.

Words are told apart by hashes of 64 bits, n-grams by the numbers of all their
words: two n-grams never share a count, unless two words share a hash.

Defined results: null and empty texts are one token, the end; documents
without an id are scored, do not train and are not held out; repeated rows
each train and get their row, and may stand in any block; with nothing to
train on every token is unknown (N = V = 0); other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, ship, spaced_words

BLOCK_BYTES, BLOCK_ROWS, BUCKET_BYTES, CROWD = 4 << 20, 50_000, 16 << 20, 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
# A byte above 127 alone is no UTF-8 text, so no word has this hash's name.
_END = xxhash.xxh3_64_intdigest(b"\xff end")

_PACK = "pack binary, asks array<struct<bucket: bigint, grams: binary, counts: binary>>"
_ASKED = "bucket bigint, block bigint, grams binary, counts binary"
_ANSWER = "block bigint, size int, bucket bigint, numbers binary, counts binary, kinds bigint, total bigint"
_SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers: the lowest bytes of all, then the next ones, as far as any is not 0.

    These are compressed apart where they are long, as they look unlike each other.
    """
    out = []
    for column in columns:
        planes = np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        planes = planes[: (int(column.max(initial=0)).bit_length() + 7) // 8 or 1]
        parts = planes if len(column) >= 512 else [planes]
        out.append((len(column), [zstandard.compress(part.tobytes(), 1) for part in parts]))
    return pickle.dumps(out)


def _unpacked(packed: bytes) -> list[np.ndarray]:
    columns = []
    for length, parts in pickle.loads(packed):
        raw = np.frombuffer(b"".join(zstandard.decompress(part) for part in parts), np.uint8)
        column = np.zeros((length, 8), np.uint8)
        if length:
            column[:, : len(raw) // length] = raw.reshape(-1, length).T
        columns.append(column.view("<u8").ravel())
    return columns


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number for each pair, in the pairs' order."""
    if int(high.max(initial=0)) * (int(low.max(initial=0)) + 1) >= 1 << 63:
        high, low = (np.unique(x, return_inverse=True)[1] for x in (high, low))
    return high.astype(np.int64) * (int(low.max(initial=0)) + 1) + low.astype(np.int64)


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, not falling as hashes rise."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _edges(own: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted buckets go over from one to the next."""
    return np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64))


def _split(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text with its start, sorted hashes of the distinct words, and which of them the tokens are."""
    tokens = [[*map(xxhash.xxh3_64_intdigest, spaced_words(t)), _END] for t in texts]
    lengths = np.array([len(t) for t in tokens])
    flat = np.fromiter((h for t in tokens for h in t), np.uint64, int(lengths.sum()))
    return lengths + 1, *np.unique(flat, return_inverse=True)


class Block:
    """Tokens of a block's texts, as places among its distinct words, and its distinct n-grams."""

    def __init__(self, lengths: np.ndarray, learn: np.ndarray, which: np.ndarray):
        self.lengths = lengths
        self.begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.n_tokens = int(lengths.sum())
        self.place = np.arange(self.n_tokens) - np.repeat(self.begins, lengths)
        self.learning = np.repeat(learn, lengths)
        at = np.flatnonzero(self.place >= 1)
        self.places = [at]  # by size: where an n-gram ends
        self.which = [which]  # which of the distinct ones ends there
        self.own = [self._learnt(at, which)]  # how often training texts of the block hold each

    def _learnt(self, at: np.ndarray, which: np.ndarray, distinct: int = 0) -> np.ndarray:
        return np.bincount(which, self.learning[at], distinct).astype(np.int64)

    def grow(self, numbers: np.ndarray, counts: np.ndarray, order: int, buckets: int, crowd: int) -> None:
        """Find the longer n-grams as paths of a trie, given the numbers, from 1, and counts of its words.

        Those of two words are sorted by bucket and numbers, longer ones by
        the place of what they prolong and the last word's number. A pair of
        words that both occur `crowd` times or more stands once for each piece
        of what prolongs it; the first has its count.
        """
        by_number = np.argsort(numbers)
        numbers = np.concatenate([[0], numbers[by_number]])
        rank = np.empty(len(by_number), np.int64)
        rank[by_number] = np.arange(1, len(numbers))
        times = np.concatenate([[counts.max(initial=0)], counts[by_number]]) // crowd
        word = np.zeros(self.n_tokens, np.int64)  # 0: the start of a text
        word[self.places[0]] = rank[self.which[0]]
        self.edges: list[np.ndarray] = []  # by size from 2 on: where buckets begin
        self.columns: list[np.ndarray] = []  # by size from 2 on: two columns that tell the n-grams
        node = word
        for size in range(2, order + 1):
            at = np.flatnonzero(self.place >= size - 1)
            if size != 3:
                prefix = node[at - 1]
            if size == 2:
                pairs = prefix * len(numbers) + word[at]
                longer = np.flatnonzero(self.place >= 2)
                pieces = np.minimum(times[word[longer - 2]], times[word[longer - 1]]) + 1
                piece = (_mixed(numbers[word[longer]].astype(np.uint64) * _STEP) % pieces.astype(np.uint64)).astype(np.int64)
                apart = np.flatnonzero(piece) if order > 2 else longer[:0]
                most = int(pieces.max(initial=1))
                more = word[longer[apart] - 2] * len(numbers) + word[longer[apart] - 1]
                keys, which = np.unique(np.concatenate([pairs * most, more * most + piece[apart]]), return_inverse=True)
                first, last = numbers[keys // most // len(numbers)], numbers[keys // most % len(numbers)]
                hashes = _mixed(_mixed(first.astype(np.uint64) * _STEP) + last.astype(np.uint64) * _STEP)
                own = _buckets(_mixed((hashes + (keys % most).astype(np.uint64)) * _STEP), buckets)
                sorting = np.argsort(own, kind="stable")
                where = np.empty(len(sorting), np.int64)
                where[sorting] = np.arange(len(sorting))
                which, others = np.split(where[which], [len(at)])
                self.edges.append(_edges(own[sorting], buckets))
                self.columns += [first[sorting], last[sorting]]
            else:
                keys, which = np.unique(prefix * len(numbers) + word[at], return_inverse=True)
                before = keys // len(numbers)
                self.edges.append(np.searchsorted(before, self.edges[-1]))
                self.columns += [np.bincount(before, minlength=len(self.own[-1])), numbers[keys % len(numbers)]]
            self.places.append(at)
            self.which.append(which)
            self.own.append(self._learnt(at, which, len(keys)))
            node = np.zeros(self.n_tokens, np.int64)
            node[at] = which
            if size == 2:
                prefix = node[longer - 1]
                prefix[apart] = others

    def asked_words(self, words: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        edges = _edges(_buckets(words, buckets), buckets)
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[bucket], edges[bucket + 1])
            yield bucket, _packed(words[part][:1], np.diff(words[part])), _packed(self.own[0][part])

    def asked_grams(self) -> Iterator[tuple[int, bytes, bytes]]:
        for bucket in np.flatnonzero(np.diff(self.edges[0])).tolist():
            parts = [slice(edges[bucket], edges[bucket + 1]) for edges in self.edges]
            columns = [np.diff(self.columns[0][parts[0]], prepend=0), self.columns[1][parts[0]]]
            for i in range(1, len(parts)):
                columns += [self.columns[2 * i][parts[i - 1]], self.columns[2 * i + 1][parts[i]]]
            own = [own[part] for own, part in zip(self.own[1:], parts, strict=True)]
            yield bucket, _packed(*columns), _packed(*own)


def _packer(block_bytes: int, buckets: int):
    asks = pa.list_(pa.struct([("bucket", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())]))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows: doc_id, learns and held_out of each, the tokens of their texts, and what to ask for the words."""
        rows, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            lengths, words, which = _split(texts)
            block = Block(lengths, np.array([r[1] for r in rows]), which)
            asked = [dict(zip(("bucket", "grams", "counts"), ask, strict=True)) for ask in block.asked_words(words, buckets)]
            often = np.argsort(-np.bincount(which), kind="stable")
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            pack = pickle.dumps((zstandard.compress(pickle.dumps(rows)), _packed(lengths, often, rank[which])))
            return pa.RecordBatch.from_arrays([pa.array([pack], pa.binary()), pa.array([asked], asks)], ["pack", "asks"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                *row, text = (value.as_py() for value in row)
                rows.append(tuple(row))
                texts.append(text)
                size += len(text or b"")
                if size >= block_bytes or len(rows) >= BLOCK_ROWS:
                    yield out()
                    rows, texts, size = [], [], 0
        if rows:
            yield out()

    return packed


def _opened(pack: bytes) -> tuple[list[tuple], Block]:
    rows, columns = pickle.loads(pack)
    rows = pickle.loads(zstandard.decompress(rows))
    lengths, often, ranks = (column.astype(np.int64) for column in _unpacked(columns))
    return rows, Block(lengths, np.array([r[1] for r in rows]), often[ranks])


def _word_answerer(buckets: int):
    def answered(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Counts over all blocks, and numbers, for the words of one bucket. Frequent ones get low numbers."""
        words = [np.cumsum(np.concatenate(_unpacked(grams)), dtype=np.uint64) for grams in frame["grams"]]
        ends = np.cumsum([len(w) for w in words])[:-1]
        _, which = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.bincount(which, np.concatenate([_unpacked(own)[0] for own in frame["counts"]])).astype(np.int64)
        rank = np.empty(len(sums), np.int64)
        rank[np.argsort(-sums, kind="stable")] = np.arange(len(sums))
        first = np.arange(len(words)) == 0
        return pd.DataFrame(
            {
                "block": frame["block"],
                "size": 1,
                "bucket": key[0],
                "numbers": [_packed(part) for part in np.split(rank[which], ends)],
                "counts": [_packed(part) for part in np.split(sums[which], ends)],
                "kinds": np.where(first, (sums > 0).sum(), 0),
                "total": np.where(first, sums.sum(), 0),
            }
        )

    return answered


def _told(answers: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of a block's words."""
    answers = answers[answers["size"] == 1].sort_values("bucket")
    numbers = [
        _unpacked(ranks)[0].astype(np.int64) * buckets + bucket + 1
        for bucket, ranks in zip(answers["bucket"], answers["numbers"], strict=True)
    ]
    return np.concatenate(numbers), np.concatenate([_unpacked(c)[0] for c in answers["counts"]]).astype(np.int64)


def _gram_asker(order: int, buckets: int, crowd: int):
    def asked(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, pack in zip(packs["block"], packs["pack"], strict=True):
            block = _opened(pack)[1]
            block.grow(*_told(answers, buckets), order, buckets, crowd)
            out += [(bucket, number, grams, own) for bucket, grams, own in block.asked_grams()]
        return pd.DataFrame(out, columns=["bucket", "block", "grams", "counts"])

    return asked


def _grams_answered(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks for the longer n-grams of one bucket."""
    tries = [_unpacked(grams) for grams in frame["grams"]]
    own = [_unpacked(counts) for counts in frame["counts"]]
    first = np.concatenate([np.cumsum(trie[0]) for trie in tries])
    parts: list[list[np.ndarray]] = [[] for _ in tries]
    node = first
    for i in range(len(own[0])):
        if i:
            node = np.repeat(node, np.concatenate([trie[2 * i] for trie in tries]).astype(np.int64))
        _, node = np.unique(_pairs(node, np.concatenate([trie[2 * i + 1] for trie in tries])), return_inverse=True)
        sums = np.bincount(node, np.concatenate([counts[i] for counts in own])).astype(np.int64)
        ends = np.cumsum([len(counts[i]) for counts in own])[:-1]
        for part, counts in zip(parts, np.split(sums[node], ends), strict=True):
            part.append(counts)
    return pd.DataFrame(
        {
            "block": frame["block"],
            "size": 2,
            "bucket": key[0],
            "numbers": None,
            "counts": [_packed(*part) for part in parts],
            "kinds": 0,
            "total": 0,
        }
    )


class Automaton:
    """The part of the model that one block's texts can reach.

    A state stands for a history of `k` words, 0 to order - 1, and is named
    by k and the place in the block where it ends. Its arc for the next word
    is the (k + 1)-gram that ends there.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, kinds: int, starts: int, prior: float):
        self.order, n = len(counts), block.n_tokens
        #: By k and place: whether there is an arc, its weight, and that of the failure arc of the state there.
        self.arcs = np.zeros((self.order, n), bool)
        self.weights = np.zeros((self.order, n))
        self.fails = np.zeros((self.order, n))
        above = chance = np.zeros(n)
        for k, count in enumerate(counts):
            at, which = block.places[k], block.which[k]
            here = count[which]
            if k == 0:
                probability = (here + 1) / (tokens + kinds + 1)
            else:
                probability = (here + prior * chance[at]) / (above[at - 1] + prior)
            self.arcs[k, at] = here > 0
            self.weights[k, at] = np.log10(probability)
            above, chance = np.zeros(n), np.zeros(n)
            above[at], chance[at] = here, probability
            if k == 0:
                above[block.begins] = starts
            if k + 1 < self.order:
                self.fails[k + 1] = np.log10(prior / (above + prior))

    def read(self, begin: int, end: int) -> float:
        """Log-probability of the text whose words are at begin + 1 to end."""
        arcs, weights, fails = (table[:, begin:end].tolist() for table in (self.arcs, self.weights, self.fails))
        most = self.order - 1
        state, total = min(1, most), 0.0
        for at in range(1, end - begin):
            while state and not arcs[state][at]:
                total += fails[state][at - 1]
                state -= 1
            total += weights[state][at]
            if state or arcs[0][at]:
                state = min(state + 1, most)
        return total


def _scorer(order: int, buckets: int, crowd: int, tokens: int, kinds: int, starts: int, prior: float):
    def scored(packs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        numbers, words = _told(answers, buckets)
        grams = [_unpacked(c) for c in answers[answers["size"] == 2].sort_values("bucket")["counts"]]
        counts = [words, *(np.concatenate(parts).astype(np.int64) for parts in zip(*grams, strict=True))]
        for pack in packs["pack"]:
            rows, block = _opened(pack)
            block.grow(numbers, words, order, buckets, crowd)
            automaton = Automaton(block, counts, tokens, kinds, starts, prior)
            for row, begin, length in zip(rows, block.begins.tolist(), block.lengths.tolist(), strict=True):
                own = slice(begin + 1, begin + length)
                out.append(
                    (
                        row[0],
                        row[2],
                        length - 1,
                        int(automaton.arcs[0, own].sum()),
                        tokens,
                        math.fsum(automaton.weights[0, own].tolist()),
                        automaton.read(begin, begin + length),
                    )
                )
        frame = pd.DataFrame(out, columns=[part.split()[0] for part in _SCORES.split(", ")])
        return frame.astype({"doc_id": "Int64"})

    return scored


def remainder(doc_id: str = "doc_id", folds: int = 7) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % folds


def score(
    docs: DataFrame,
    *,
    order: int = 3,
    prior: float = 32.0,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    crowd: int = CROWD,
    folds: int = 7,
    held: int = 2,
) -> DataFrame:
    """Scores of every document under a model of those not held out.

    Words are counted at once; n-grams are, and texts scored, when the result is used.
    """
    ship(docs.sparkSession)
    learns = F.coalesce(remainder(folds=folds) != held, F.lit(False))
    size, starts = docs.agg(F.sum(F.octet_length("text")), F.sum(learns.cast("bigint"))).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        learns.alias("learns"),
        F.coalesce(remainder(folds=folds) == held, F.lit(False)).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    packs = rows.mapInArrow(_packer(block_bytes, buckets), _PACK)
    packs = cut(packs.withColumn("block", F.monotonically_increasing_id()))
    asked = packs.select("block", F.inline("asks"))
    answers = cut(asked.groupBy("bucket").applyInPandas(_word_answerer(buckets), _ANSWER))
    kinds, tokens = answers.agg(F.sum("kinds"), F.sum("total")).first()
    by_block = packs.select("block", "pack").groupBy("block")
    if order > 1:
        asked = by_block.cogroup(answers.groupBy("block")).applyInPandas(_gram_asker(order, buckets, crowd), _ASKED)
        answers = answers.union(asked.groupBy("bucket").applyInPandas(_grams_answered, _ANSWER))
    scorer = _scorer(order, buckets, crowd, int(tokens or 0), int(kinds or 0), int(starts or 0), prior)
    return by_block.cogroup(answers.groupBy("block")).applyInPandas(scorer, _SCORES)
