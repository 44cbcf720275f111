"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item, or the
whole item if it is shorter. Patterns of one length m form a class with

- a shift table: for each block of two words (one, where m is 1) the least
  distance of that block from the end of a pattern. A block in no pattern
  moves the search on by m - 1 words at once;
- buckets: for each block that ends a pattern, the patterns it ends, told
  apart by the block they begin with. Those left are compared with the text
  itself.

The tables are sorted arrays of 64-bit hashes beside the items' words, about
nine times the size of the text. Tasks build them from pieces of the
benchmark whose tables take `piece_bytes`, about; the driver passes one piece
at a time on as bytes. A document is read from left to right once per class,
its whole text. Of each m - 1 words first one block is looked up, for a whole
text at once; only where that is in the table the search goes on from word to
word. A benchmark of several pieces is searched in several passes over the
documents, whose hits are merged per document.

Defined results: null and wordless texts have no words, no hits and are
clean; an item without words has no pattern; an item without an id marks
words but is not counted; repeated items count once, repeated documents
each get their row; an empty benchmark leaves everything clean; columns of
`docs`, whatever their names, come back untouched in the struct `doc`. One
item is never split, so a piece is as large as its largest item at least.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, letter_words, ship

WINDOW = 13
#: Bytes of the tables broadcast at once, about, and of those that a word takes.
PIECE_BYTES, _WORD_BYTES = 32 << 20, 48
_FOUND = "n_words bigint, spans array<int>, items array<string>"
_VERDICT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
_STEP = np.uint64(0x9E3779B97F4A7C15)

Words = list[bytes]


def hashed(words: Words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words, one or two."""
    if size == 1:
        return hashes
    both = hashes[:-1] * _STEP + hashes[1:]
    return both ^ (both >> np.uint64(29))


class Patterns:
    """Shift table and buckets of the patterns of one length, which share the items' words."""

    def __init__(self, length: int, items: list[Words], owners: list[int]):
        self.length, self.block = length, min(2, length)
        self.step = length - self.block + 1
        words = [word for item in items for word in item]
        sizes = np.array([len(item) for item in items])
        begins = np.cumsum(sizes) - sizes
        place = np.arange(len(words)) - np.repeat(begins, sizes)
        left = np.repeat(sizes, sizes) - place
        self.text = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.begin = (np.cumsum(lengths) - lengths).astype(np.uint32 if len(self.text) < 2**32 else np.uint64)
        hashes = hashed(words)
        # A block ends a pattern if enough words of its item precede it, else it is that much nearer to the front.
        all_ = blocks(hashes, self.block)
        at = np.flatnonzero(left[: len(all_)] >= self.block)
        shift = np.maximum(0, length - place[at] - self.block)
        order = np.lexsort((shift, all_[at]))
        known, first = np.unique(all_[at][order], return_index=True)
        self.known, self.shift = known, shift[order][first].astype(np.uint8 if length < 256 else np.int64)
        # Equal patterns are one, with all their owners.
        starts = np.flatnonzero(left >= length)
        owner = np.repeat(np.array(owners, np.int64), sizes)[starts]
        keys = []
        for multiplier in (_STEP, np.uint64(0xC2B2AE3D27D4EB4F)):
            key = np.full(len(starts), length, np.uint64)
            for k in range(length):
                key = key * multiplier + hashes[starts + k]
            keys.append(key)
        order = np.lexsort((owner, *keys))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        rank, starts, owner = np.cumsum(new) - 1, starts[order], owner[order]
        leads = starts[new]
        again = np.ones(len(order), bool)
        again[1:] = new[1:] | (owner[1:] != owner[:-1])
        owned = again & (owner >= 0)
        tails, heads = all_[leads + length - self.block], all_[leads]
        by_tail = np.argsort(tails, kind="stable")
        self.tails, self.heads, self.leads = tails[by_tail], heads[by_tail], leads[by_tail].astype(np.uint32)
        counts = np.bincount(rank[owned], minlength=len(leads))
        edges = np.concatenate([[0], np.cumsum(counts)])
        self.owner_begin, self.owner_end = (e[by_tail].astype(np.uint32) for e in (edges[:-1], edges[1:]))
        self.owners = owner[owned].astype(np.int32)

    def _has(self, lead: int, text: bytes) -> bool:
        begin = int(self.begin[lead])
        return self.text[begin : begin + len(text)] == text and self._ends(lead, begin + len(text))

    def _ends(self, lead: int, at: int) -> bool:
        last = lead + self.length
        return at == (int(self.begin[last]) - 1 if last < len(self.begin) else len(self.text))

    def search(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Start and owners of every occurrence."""
        length, block, step = self.length, self.block, self.step
        if len(words) < length or not len(self.known):
            return
        keys = blocks(hashes, block)
        # Each occurrence has one of these blocks in it.
        ends = np.arange(length, len(words) + 1, step)
        at = np.minimum(np.searchsorted(self.known, keys[ends - block]), len(self.known) - 1)
        end = 0
        for hit in ends[self.known[at] == keys[ends - block]].tolist():
            end = max(end, hit)
            while end < min(hit + step, len(words) + 1):
                key = keys[end - block]
                found = int(np.searchsorted(self.known, key))
                if found == len(self.known) or self.known[found] != key:
                    end += step
                    continue
                skip = int(self.shift[found])
                if skip:
                    end += skip
                    continue
                start = end - length
                low, high = np.searchsorted(self.tails, key), np.searchsorted(self.tails, key, "right")
                for one in low + np.flatnonzero(self.heads[low:high] == keys[start]):
                    if self._has(int(self.leads[one]), b" ".join(words[start:end])):
                        yield start, self.owners[self.owner_begin[one] : self.owner_end[one]]
                end += 1


Tables = tuple[list[Patterns], list[str]]


def build(items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> Tables:
    """Patterns of the items, by length, and the items' names."""
    names = sorted({name for name, _ in items if name is not None})
    number = {name: k for k, name in enumerate(names)} | {None: -1}
    classes: dict[int, list[tuple[Words, int]]] = {}
    for name, text in items:
        if words := letter_words(text):
            classes.setdefault(min(window, len(words)), []).append((words, number[name]))
    patterns = [Patterns(length, *map(list, zip(*some, strict=True))) for length, some in sorted(classes.items())]
    return patterns, names


def find(text: bytes | None, tables: Tables) -> tuple[int, list[int], list[str]]:
    """Number of words, hit spans (start, end, start, end ...), items found."""
    words = letter_words(text)
    patterns, names = tables
    hashes = hashed(words) if patterns else None
    spans: list[int] = []
    items: set[int] = set()
    for table in patterns:
        for start, owners in table.search(words, hashes):
            items.update(owners.tolist())
            if spans and spans[-2] <= start <= spans[-1]:
                spans[-1] = max(spans[-1], start + table.length)
            else:
                spans += (start, start + table.length)
    return len(words), spans, sorted(names[k] for k in items)


def verdict(n_words: int, spans: list[int], items: list[str]) -> tuple[int, int, int, str, bool]:
    n_hit = upto = 0
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        n_hit += max(0, end - max(start, upto))
        upto = max(upto, end)
    names = sorted(set(items))
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    return n_words, n_hit, len(names), digest, n_hit > 0 and 20 * n_hit >= n_words


def _verdict(n_words: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
    rows = [
        verdict(int(n), list(s), list(i)) for n, s, i in zip(n_words, spans, items, strict=True)
    ]
    return pd.DataFrame(rows, columns=[part.split()[0] for part in _VERDICT.split(", ")])


def _searcher(tables) -> Column:
    @F.pandas_udf(_FOUND)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        patterns = pickle.loads(tables.value) if tables else ([], [])
        for series in texts:
            rows = [find(text, patterns) for text in series]
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return found(F.col("doc.text").cast("binary"))


def _built(frame: pd.DataFrame) -> pd.DataFrame:
    """The tables of one piece of the benchmark."""
    items = [(item, None if text is None else bytes(text)) for item, text in zip(frame["item"], frame["words"], strict=True)]
    tables = pickle.dumps(build(sorted(items, key=repr)))
    return pd.DataFrame({"piece": frame["piece"].iloc[:1], "tables": [tables]})


def search(docs: DataFrame, benchmark: DataFrame, *, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Columns `doc` (the given row) and `hit` (the contract's figures).

    `piece_bytes` bounds the tables that are broadcast at once.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words"))
    items = items.where(F.col("words").isNotNull()).distinct()
    # Words are counted by the breaks between them, so too many rather than too few.
    weight = F.octet_length("words") + _WORD_BYTES * (1 + F.regexp_count("words", F.lit(r"[^0-9A-Za-z\x80-\x{10FFFF}]+")))
    size = items.agg(F.sum(weight)).first()[0] or 0
    pieces = max(1, math.ceil(size / piece_bytes))
    piece = F.pmod(F.xxhash64("item", "words"), F.lit(pieces)).cast("int")
    items = items.select("item", F.col("words").cast("binary").alias("words"), piece.alias("piece"))
    built = cut(items.groupBy("piece").applyInPandas(_built, "piece int, tables binary"))
    rows = docs.select(F.struct("*").alias("doc"))
    earlier = []
    for k in range(pieces):
        part = built.where(F.col("piece") == k).select("tables").collect()
        tables = spark.sparkContext.broadcast(bytes(part[0][0])) if part else None
        found = rows.withColumn("found", _searcher(tables))
        if k < pieces - 1:
            hits = found.where(F.size("found.spans") > 0)
            earlier.append(cut(hits.select(*_row_key(), "found.spans", "found.items").distinct()))
    if earlier:
        union = earlier[0]
        for more in earlier[1:]:
            union = union.union(more)
        merged = union.groupBy("key_id", "key_text").agg(
            F.flatten(F.collect_list("spans")).alias("more_spans"),
            F.flatten(F.collect_list("items")).alias("more_items"),
        )
        merged = merged.withColumnsRenamed({"key_id": "m_id", "key_text": "m_text"})
        found = found.select("*", *_row_key())
        found = found.join(
            cut(merged), (F.col("key_id").eqNullSafe(F.col("m_id"))) & (F.col("key_text") == F.col("m_text")), "left"
        )
        none = F.array()
        spans = F.concat("found.spans", F.coalesce("more_spans", none.cast("array<int>")))
        names = F.concat("found.items", F.coalesce("more_items", none.cast("array<string>")))
    else:
        spans, names = F.col("found.spans"), F.col("found.items")
    judged = F.pandas_udf(_verdict, _VERDICT)
    return found.select("doc", judged("found.n_words", spans, names).alias("hit"))


def _row_key() -> tuple[Column, Column]:
    text = F.coalesce("doc.text", F.lit(""))
    return F.col("doc.doc_id").alias("key_id"), F.sha2(text, 256).alias("key_text")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id and figures of every document."""
    return search(docs, benchmark, **options).select("doc.doc_id", "hit.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = search(docs, benchmark, **options)
    return found.where(~F.col("hit.contaminated")).select("doc.*")
