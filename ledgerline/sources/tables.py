"""Parquet tables and the columns the jobs rely on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, StructType

# Column names and types of the input tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, "
        "c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}

#: May be stored as dates, which row groups are skipped by.
DATES = ("o_orderdate", "l_shipdate")


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read ``<directory>/<name>.parquet``, a file or a folder of files.

    The schema that Spark infers, from one of the files, is compared with
    the one declared here. A column that only other files lack is read as
    nulls from those: run ``file_problems`` once for each load of new data.
    Columns beyond the declared ones are dropped. The columns of ``DATES``
    may be of type ``date``.
    """
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    declared = StructType.fromDDL(SCHEMAS[name])
    if wrong := _differences(declared, df.schema):
        raise ValueError(f"table {name} in {directory}: {wrong}")
    return df.select(*declared.names)


def file_problems(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """file, problem: the files of a table whose own columns are not those declared.

    Tasks read the files' footers, so executors need a filesystem that
    pyarrow knows for the table's address; one it does not know is reported
    as the file's problem. No rows: every file has every column.
    """
    declared = StructType.fromDDL(SCHEMAS[name])
    files = spark.read.parquet(f"{directory}/{name}.parquet").inputFiles()

    def looked_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(file, _file_problem(file, declared)) for file in batch["file"]]
            yield pd.DataFrame([f for f in found if f[1]], columns=["file", "problem"])

    listed = spark.createDataFrame([(file,) for file in files], "file string")
    slices = max(1, min(len(files), spark.sparkContext.defaultParallelism))
    return listed.repartition(slices).mapInPandas(looked_at, "file string, problem string")


def _file_problem(file: str, declared: StructType) -> str:
    from pyarrow import ArrowException, fs
    from pyarrow.parquet import read_schema
    from pyspark.sql.pandas.types import from_arrow_schema

    try:
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as source:
            found = from_arrow_schema(read_schema(source), prefer_timestamp_ntz=True)
    except (ArrowException, OSError, ValueError) as error:
        return f"cannot be read: {error}"
    return _differences(declared, found)


def _differences(declared: StructType, schema: StructType) -> str:
    found = {field.name: field.dataType for field in schema}
    wrong = [
        f"{field.name}: want {field.dataType.simpleString()}, "
        f"found {found[field.name].simpleString() if field.name in found else 'nothing'}"
        for field in declared
        if found.get(field.name) != field.dataType
        and not (field.name in DATES and found.get(field.name) == DateType())
    ]
    return "; ".join(wrong)
