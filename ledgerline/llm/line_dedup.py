"""Line dedup with a pattern tree of fixed depth that learns its wildcards.

Lines are first compared as they are. One that stands in `min_texts`
different document texts at least recurs; exact copies of a document count
once, they are no boilerplate. Lines of fewer than `min_words` words recur
from `short_texts` texts on; without that number they stay.

Lines of four words or more are also parsed down a tree, equal ones as one
line of one text. A word with a digit is a variable field at once. The first level is
the number of words. Then a line is cut into four segments, and its branches
are the segments that stay closed: three of four in lines of fewer than
eight words, two of four in longer ones, so that any one field, or any two,
leave some branch in common, wherever they are. Half of the words are equal
in a branch. A branch that lines of `pattern_texts` different texts share is
a leaf, where wildcards are learnt: each segment has two parts, and a part
that fewer texts of the leaf have in common is a wildcard. What is left makes
a line's pattern. A pattern recurs if `CONSTANT` of its parts at least are no
wildcards and lines of `pattern_texts` texts have it. Of several patterns a
line takes the one with the fewest wildcards, then the most frequent one; it
goes before a recurrence of the line as it is.
Lines of numbers only have wildcards only, and so no pattern.

Recurring lines, and lines of recurring patterns, are dropped everywhere but
in the document with the smallest id, so that no content goes altogether.
The registered query and the pipeline take the options in `WHOLE`.

Lines are named by 128 bits. Each document's lines are hashed once and
stored in the shared folder; aggregates are partial before any shuffle, and
repeated rows add their line numbers to one set.

Defined results: lines end at LF, and count as equal whatever their white
space; lines without words are never dropped; documents that are null, empty
or lose nothing keep their text as it is; a document without an id never
counts as a line's first one unless no other holds it; documents of which
every line of words is dropped get the remaining (blank or short) lines;
repeated rows fare alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_BYTES, cut, discard, shared_folder, ship

SEGMENTS, PARTS = 4, 8
#: Shortest line with patterns, and shortest that may have two segments open.
OPEN_FROM, TWO_FROM = 4, 8
#: Least share of a pattern's parts that are no wildcards.
CONSTANT = 0.6
PATTERN_TEXTS = 20
#: Options under which every repeat counts.
WHOLE = {"min_texts": 2, "min_words": 4, "short_texts": 20}
#: Values of parts without words, and of parts of fields only.
_EMPTY, _FIELD = 0, 1
_DIGIT = re.compile(rb"[0-9]")
_LINE = ["a", "b"]
_CUTS = [f"cut_{k}" for k in range(SEGMENTS)]
_LINES = "doc_id bigint, digest bigint, number int, n int, a bigint, b bigint, " + ", ".join(f"{c} bigint" for c in _CUTS)


@cache
def _edges(n: int) -> list[tuple[int, int]]:
    """Where the parts of a line of n words begin and end."""
    starts = [-(-k * n // PARTS) for k in range(PARTS + 1)]
    return list(zip(starts[:-1], starts[1:], strict=True))


def parts(words: list[bytes], wild: bool) -> list[int]:
    """A 32-bit value of each part of a line; `wild`: some word has a digit."""
    if wild:
        words = [b"<*>" if _DIGIT.search(word) else word for word in words]
    out = []
    for start, end in _edges(len(words)):
        own = words[start:end]
        if wild and own and all(word == b"<*>" for word in own):
            out.append(_FIELD)
        elif own:
            out.append(max(xxhash.xxh3_64_intdigest(b" ".join(own)) >> 32, 2))
        else:
            out.append(_EMPTY)
    return out


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """A row per line of `least` words or more: its number, words, name and parts."""

    def lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                ids, digests, counts, numbers, sizes, cuts = [], [], [], [], [], []
                names = bytearray()
                none = [_EMPTY] * PARTS
                columns = (some.column(c).to_pylist() for c in ("doc_id", "digest", "text"))
                for doc_id, digest, text in zip(*columns, strict=True):
                    before = len(numbers)
                    for number, line in enumerate((text or b"").split(b"\n")):
                        words = line.split()
                        if not words or len(words) < least:
                            continue
                        names += xxhash.xxh3_128_digest(b" ".join(words))
                        numbers.append(number)
                        sizes.append(len(words))
                        cuts += parts(words, bool(_DIGIT.search(line))) if len(words) >= OPEN_FROM else none
                    ids.append(doc_id)
                    digests.append(digest)
                    counts.append(len(numbers) - before)
                at = np.repeat(np.arange(len(ids)), counts)
                name = np.frombuffer(bytes(names), np.int64).reshape(-1, 2)
                cut_ = np.array(cuts, np.uint64).reshape(-1, SEGMENTS, PARTS // SEGMENTS)
                cut_ = ((cut_[:, :, 0] << np.uint64(32)) | cut_[:, :, 1]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()).take(pa.array(at)),
                        pa.array(digests, pa.int64()).take(pa.array(at)),
                        pa.array(numbers, pa.int32()),
                        pa.array(sizes, pa.int32()),
                        *(pa.array(np.ascontiguousarray(name[:, k])) for k in range(2)),
                        *(pa.array(np.ascontiguousarray(cut_[:, k])) for k in range(SEGMENTS)),
                    ],
                    ["doc_id", "digest", "number", "n", *_LINE, *_CUTS],
                )

    return docs.mapInArrow(lined, _LINES)


def _stored(frame: DataFrame, path: str) -> DataFrame:
    """The frame, written in fewer bytes than a checkpoint takes."""
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def _small(frame: DataFrame, row_bytes: int) -> DataFrame:
    """A stored frame, for a broadcast if it is small enough."""
    return F.broadcast(frame) if frame.count() * row_bytes < BROADCAST_BYTES else frame


def _in_texts(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """The groups of rows that `least` different texts have, and how many texts."""
    groups = rows.select(*by, "digest").distinct().groupBy(*by).agg(F.count("*").alias("texts"))
    return groups.where(F.col("texts") >= least)


def _branches() -> Column:
    """The branches of a line, as two hashes each, from its words and closed segments."""

    def branches(closed: int) -> Column:
        found = []
        for number, chosen in enumerate(combinations(range(SEGMENTS), closed)):
            own = [F.col(_CUTS[k]) for k in chosen]
            hashes = (F.xxhash64(F.lit(seed), "n", F.lit(number), *own) for seed in (1, 2))
            found.append(F.struct(*(h.alias(f"branch_{k}") for k, h in enumerate(hashes))))
        return F.array(*found)

    return F.when(F.col("n") < TWO_FROM, branches(SEGMENTS - 1)).otherwise(branches(SEGMENTS - 2))


def _part_values() -> list[Column]:
    return [
        value
        for name in _CUTS
        for value in (F.shiftrightunsigned(name, 32), F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)))
    ]


def patterned(lines: DataFrame, least: int) -> DataFrame:
    """Lines of recurring patterns: a, b and first_id, the smallest document of the pattern.

    `lines`: a row per line: a, b, digest, doc_id, n and its parts.
    """
    branch = ["branch_0", "branch_1"]
    named = lines.where(F.col("n") >= OPEN_FROM).select(*_LINE, F.explode(_branches()).alias("branch"))
    named = named.select(*_LINE, "branch.*")
    often = named.groupBy("branch_0").agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    often = cut(often.select("branch_0"))
    named = cut(named.join(_small(often, 16), "branch_0"))
    names = cut(named.select(*_LINE).distinct())
    wanted = cut(lines.join(_small(names, 32), _LINE, "left_semi"))
    rows = cut(named.join(wanted, _LINE))
    leaves = cut(_in_texts(rows, branch, least).select(*branch))
    rows = cut(rows.join(_small(leaves, 32), branch))

    pieces = F.array(*(F.struct(F.lit(k).alias("place"), v.alias("value")) for k, v in enumerate(_part_values())))
    pieces = F.filter(pieces, lambda piece: piece["value"] > _FIELD)
    each = rows.select(*branch, *_LINE, "digest", F.explode(pieces).alias("piece")).select("*", "piece.*").drop("piece")
    at = [*branch, "place", "value"]
    fixed = _in_texts(each, at, least).select(*at)
    masks = each.join(fixed, at).groupBy(*branch, *_LINE).agg(F.expr("bit_or(shiftleft(1, place))").alias("mask"))
    rows = rows.join(masks, [*branch, *_LINE])
    values = _part_values()
    kept = [F.when(F.col("mask").bitwiseAND(1 << k) > 0, value) for k, value in enumerate(values)]
    present = sum((value > _EMPTY).cast("int") for value in values)
    pattern = ["pattern_0", "pattern_1"]
    hashes = [F.xxhash64(F.lit(seed), *branch, *(F.coalesce(v, F.lit(_EMPTY)) for v in kept)).alias(name) for seed, name in enumerate(pattern)]
    constant = F.bit_count("mask")
    rows = rows.where(constant >= CONSTANT * present).select(*_LINE, "digest", "doc_id", constant.alias("constant"), *hashes)
    rows = cut(rows)
    recurring = cut(_in_texts(rows, pattern, least))
    best = F.max(F.struct("constant", "texts", *pattern)).alias("best")
    rows = cut(rows.join(_small(recurring, 40), pattern).groupBy(*_LINE, "doc_id").agg(best).select(*_LINE, "doc_id", "best.*"))
    firsts = rows.groupBy(*pattern).agg(F.min("doc_id").alias("first_id"))
    return rows.join(firsts, pattern).select(*_LINE, "first_id")


def _without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    """What is left of each text; a few at a time, so that one batch does not exist twice."""
    names, kinds = ["text", "n_lines", "n_dropped"], [pa.string(), pa.int64(), pa.int64()]
    parts = []
    for first in range(0, len(texts), 256):
        rows = []
        some = (array.slice(first, 256).to_pylist() for array in (texts, dropped))
        for text, drop in zip(*some, strict=True):
            if text is None:
                rows.append((None, 0, 0))
                continue
            lines, gone = text.split("\n"), set(drop or ())
            kept = [line for number, line in enumerate(lines) if number not in gone]
            rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        parts.append(pa.StructArray.from_arrays(columns, names))
    whole = pa.struct(list(zip(names, kinds, strict=True)))
    return pa.concat_arrays(parts) if parts else pa.array([], whole)


def drop_lines(
    docs: DataFrame,
    *,
    min_texts: int = 5,
    min_words: int = 4,
    short_texts: int | None = None,
    pattern_texts: int = PATTERN_TEXTS,
) -> DataFrame:
    """Columns `doc` (the given row) and `left` (text, n_lines, n_dropped)."""
    ship(docs.sparkSession)
    rows = docs.select(
        F.struct("*").alias("doc"), F.xxhash64("text").alias("digest"), F.col("doc_id").cast("bigint").alias("id")
    )
    bodies = docs.select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary")
    )
    folder = f"{shared_folder(docs.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines = _stored(_lines(bodies, min_words if short_texts is None else 1), f"{folder}/lines")
    alike = lines.groupBy(*_LINE).agg(
        F.min("digest").alias("digest"),
        F.max("digest").alias("last"),
        F.min("doc_id").alias("doc_id"),
        F.max("n").alias("n"),
        *(F.max(name).alias(name) for name in _CUTS),
    )
    alike = _stored(alike, f"{folder}/names")
    several = alike.where(F.col("digest") != F.col("last")) if min_texts > 1 else alike
    long = several.where(F.col("n") >= min_words).select(*_LINE, F.col("doc_id").alias("first_id"))
    if min_texts > 2:
        counted = lines.where(F.col("n") >= min_words).join(cut(long.select(*_LINE)), _LINE, "left_semi")
        long = long.join(_in_texts(counted, _LINE, min_texts).drop("texts"), _LINE)
    recurring = long
    if short_texts is not None:
        short = several.where(F.col("n") < min_words).select(*_LINE, F.col("doc_id").alias("first_id"))
        counted = _in_texts(lines.where(F.col("n") < min_words), _LINE, short_texts).drop("texts")
        recurring = recurring.union(short.join(counted, _LINE))
    whole = alike.where(F.col("n") >= max(OPEN_FROM, min_words)).drop("last")
    generalised = cut(patterned(whole, pattern_texts))
    recurring = cut(recurring.join(_small(generalised.select(*_LINE), 32), _LINE, "left_anti").union(generalised))
    met = lines.select("doc_id", "digest", "number", *_LINE).join(_small(recurring, 48), _LINE)
    drops = cut(
        met.where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("doc_id", "digest")
        .agg(F.collect_set("number").alias("gone"))
        .withColumnsRenamed({"doc_id": "gone_id", "digest": "gone_digest"})
    )
    discard(docs.sparkSession, folder)
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
    # Else a filter on the result would run it a second time, beside the first.
    without = F.arrow_udf(_without, "text string, n_lines bigint, n_dropped bigint").asNondeterministic()
    return rows.join(drops, same, "left").select("doc", without("doc.text", "gone").alias("left"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, lines and lines dropped, and the digest of what is left."""
    left = drop_lines(docs, **options)
    return left.select(
        "doc.doc_id",
        "left.n_lines",
        "left.n_dropped",
        F.sha2("left.text", 256).alias("text_sha256"),
    )


def without_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with what is left of their texts, n_chars to match.

    A document that had words and lost every line of them goes.
    """
    left = drop_lines(docs, **options)
    empty = (F.col("left.n_dropped") > 0) & ~F.coalesce(F.col("left.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    changed = {
        "text": F.col("left.text"),
        "n_chars": F.when(F.col("left.n_dropped") > 0, F.length("left.text").cast("bigint")).otherwise(
            F.col("doc.n_chars")
        ),
    }
    columns = [
        changed.get(name, F.col(f"doc.`{name}`")).alias(name)
        if name != "n_chars" or "n_chars" in docs.columns
        else F.col(f"doc.`{name}`")
        for name in docs.columns
    ]
    return left.where(~empty).select(*columns)
