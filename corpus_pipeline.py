"""From raw documents to a mixed training set, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as parquet and read again as the next one's documents. All but the
last return the columns of `documents`:

1. language: documents whose language is rejected go;
2. lines: lines that recur, as they are or as a pattern with fields, are dropped, all but the first;
3. near duplicates: one document of each group stays;
4. benchmark: contaminated documents go;
5. mixing: how many copies of each document bring its source near its
   target. Documents of which none is taken go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from ledgerline.llm.common import discard, shared_folder, ship


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup.without_lines(docs, **line_dedup.WHOLE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminated(docs, items)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = [name for name in ("text", "lang", "source", "n_chars") if name in docs.columns]
    rows = mixing.mix(docs, keep=tuple(kept))
    return rows.where(F.col("copies") > 0)


STAGES = [
    ("language", languages),
    ("lines", lines),
    ("near duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixing", mixed),
]

#: Models, patterns and sampling cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the documents of `sf_dir`. The last one's rows stay in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            discard(spark, f"{folder}/{number - 1}")
    return docs
