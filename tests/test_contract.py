"""Every registered query against its SQL on the given tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.builders import duck

TESTDATA = Path("/root/testdata")


def duck_type(spark_type):
    # DuckDB's name for each Spark type in use.
    names = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER"}
    name = spark_type.simpleString()
    return names.get(name, name.upper())


#: Their SQL compares all rows with all others.
ALL_PAIRS = {"op2_bbit_minhash", "op5_wu_manber"}


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, name, sf):
    if sf == "0.1" and name in ALL_PAIRS:
        pytest.skip("its SQL takes minutes there")
    sf_dir = TESTDATA / f"sf{sf}"
    df = contract.queries()[name](spark, str(sf_dir))
    columns, rows = duck(sf_dir, contract.oracle_sql()[name])
    assert [c for c, _ in columns] == df.columns
    assert [t.replace(" ", "") for _, t in columns] == [duck_type(f.dataType) for f in df.schema]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == rows
    assert rows


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() == 6


def test_every_report_has_sql():
    assert {"pricing_summary", "regional_revenue"} <= contract.oracle_sql().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_contract_works_without_the_corpus_operators(tmp_path):
    """The subpackage, its tests and the pipeline may be left out together."""
    root = Path(contract.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    skipped = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(root / "ledgerline", tmp_path / "ledgerline", ignore=skipped)
    assert_only_reports(tmp_path)


@pytest.mark.skipif(not (Path(contract.__file__).parent / "corpus_pipeline.py").exists(), reason="left out here")
def test_contract_works_without_a_library_of_the_corpus_operators(tmp_path):
    root = Path(contract.__file__).parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "ledgerline", tmp_path / "ledgerline", ignore=shutil.ignore_patterns("__pycache__"))
    assert_only_reports(tmp_path, "sys.modules['xxhash'] = None; ")


def assert_only_reports(tmp_path, first=""):
    code = f"import sys; {first}import __spark_entry__ as e; print(*sorted(e.queries()), *sorted(e.oracle_sql()))"
    said = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True
    )
    assert said.stdout.split() == ["pricing_summary", "regional_revenue"] * 2
