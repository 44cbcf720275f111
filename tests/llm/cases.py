"""Awkward tables that every operator has to take."""

from pathlib import Path

TESTDATA = Path("/root/testdata")
SMALL, MEDIUM = TESTDATA / "sf0.001", TESTDATA / "sf0.01"

#: Columns beyond those of the table, named like ones that operators use.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "size bigint, doc string, found string, target double, key bigint, node bigint"
)
EXTRA = (7, "doc", "found", 0.5, 1, 2)

LONG = "the quick brown fox jumps over the lazy dog near 12 rivers " * 20_000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n\x0b\x0c\r ", "de", "b", 7),
    (6, LONG, "en", "b", len(LONG)),
    (None, "a document without an id", "en", "b", 24),
    (None, "alpha beta gamma delta epsilon zeta eta theta", None, None, 45),
    (8, "Ünï cödé \U0001f600 文字 одно", "xx", "\U0001f600", 20),
    (9, "ALPHA beta Gamma", "en", None, 16),
    (10, "12345 67890 !!! ---", "en", "a", 19),
]


def edge_docs(spark, rows=ROWS, slices=3):
    return spark.createDataFrame([row + EXTRA for row in rows], SCHEMA).repartition(slices)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet")


def as_rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)
