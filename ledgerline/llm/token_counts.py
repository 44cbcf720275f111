"""Token counts through a cache keyed by content and tokenizer digests.

Documents meet the cache by the SHA-256 of their content and of the
tokenizer (file and library version). Only contents that the cache lacks
are encoded, each once however many documents hold it, and what they gave
is appended to the cache before the counts are read from it. Content is
normalised as far as counts allow, which for a byte-level vocabulary is not
at all, save that null counts as the empty text.

Encoding is piecewise. A byte-level tokenizer never joins across a place
where white space follows something else, so a text is cut there and each
piece's count is remembered within the worker. Texts with white space other
than blank, tab, CR and LF go to the library whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; equal
texts have equal counts; repeated documents each get their row.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, ship

_PIECE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
_OTHER_SPACE = re.compile(r"[^\S \t\r\n]")
#: Pieces a worker remembers; beyond it starts afresh.
_REMEMBERED = 300_000
_CACHE = "content binary, n_tokens bigint, tokenizer string"


@cache
def _load(path: str) -> tokenizers.Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def _memory(path: str) -> dict[str, int]:
    return {}


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library counts them for the whole text."""
    tokenizer, known = _load(path), _memory(path)
    if len(known) > _REMEMBERED:
        known.clear()
    pieces = [[text] if _OTHER_SPACE.search(text) else _PIECE.findall(text) for text in texts]
    new = list({piece for text in pieces for piece in text if piece not in known})
    for first in range(0, len(new), 10_000):
        some = new[first : first + 10_000]
        encoded = tokenizer.encode_batch_fast(some, add_special_tokens=False)
        known.update(zip(some, map(len, encoded), strict=True))
    return [sum(map(known.__getitem__, text)) for text in pieces]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def count_cached(
    docs: DataFrame, cache_folder: str, tokenizer_path: str, *, limit: int = 512
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    `tokenizer_path` is a file that driver and executors have;
    `cache_folder` is in a store that all of them share. Encoding runs at
    once, reading the counts when the result is used.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_digest(tokenizer_path)
    body = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", body.alias("body"), F.unhex(F.sha2(body, 256)).alias("content"))

    def stored() -> DataFrame:
        table = spark.read.schema(_CACHE).parquet(cache_folder)
        return table.where(F.col("tokenizer") == version)

    missing = keyed.groupBy("content").agg(F.first("body").alias("body"))
    if _exists(spark, cache_folder):
        missing = missing.join(stored().select("content"), "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                counts = count_tokens(some.column("body").to_pylist(), tokenizer_path)
                yield pa.RecordBatch.from_arrays(
                    [some.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"]
                )

    counted = missing.select("content", "body").mapInArrow(encode, "content binary, n_tokens bigint")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy(
        "tokenizer"
    ).parquet(cache_folder)
    # Runs that shared the cache may have stored the same content twice.
    counts = cut(stored().groupBy("content").agg(F.first("n_tokens").alias("n_tokens")))
    return (
        keyed.select("doc_id", "content", F.octet_length("body").cast("bigint").alias("n_bytes"))
        .join(counts, "content")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
