"""Small tables with the input schemas, and a look into executed plans."""

from collections import defaultdict
from datetime import datetime

import duckdb
from pyspark.sql.types import StructType

from ledgerline.sources import SCHEMAS


def table(spark, name, rows, slices=1):
    """A table from dicts; columns left out are null."""
    schema = StructType.fromDDL(SCHEMAS[name])
    tuples = [tuple(row.get(column) for column in schema.names) for row in rows]
    return spark.createDataFrame(tuples, schema).repartition(slices)


def at(text):
    return datetime.fromisoformat(text)


def final_plan(df):
    """The plan AQE settled on, after running the query."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def rows_scanned(df):
    """Rows that the file scans of a query gave out, after running it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return total


def columns_read(plan):
    """Columns each table's scans take from the files."""
    read = defaultdict(set)
    for scan in plan.split("FileScan parquet")[1:]:
        name = scan.split(".parquet]")[0].rsplit("/", 1)[1]
        fields = scan.split("ReadSchema: struct<")[1].split(">")[0]
        read[name] |= {field.split(":")[0] for field in fields.split(",")}
    return dict(read)


def duck(sf_dir, sql):
    """Columns and sorted rows of a query run by DuckDB on the same tables."""
    con = duckdb.connect()
    for path in sf_dir.glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    result = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in result.description]
    return columns, sorted(result.fetchall(), key=repr)
