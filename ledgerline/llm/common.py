"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Broadcasts are taken only below this size, which each caller measures first.
BROADCAST_BYTES = 8 << 20

#: Bytes that end a word where words are runs of letters, digits and non-ASCII bytes.
_BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())
_LETTERS = bytes.maketrans(
    _BREAKS + bytes(range(65, 91)), b" " * len(_BREAKS) + bytes(range(97, 123))
)


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased. Null has none.

    On UTF-8 bytes `lower` and `split` touch ASCII only, so this is the
    pattern `[^\\x20\\x09-\\x0D]+` over the lower-cased text.
    """
    return text.lower().split() if text else []


def letter_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_LETTERS).split() if text else []


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors' Python, once per application.

    They need not have it installed, nor run in a folder that holds it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master gets one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if re.match(r"local-cluster|(?!local)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of our own that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder, without the plan behind them."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()
