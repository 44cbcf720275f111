import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from tests.llm.cases import SMALL


def test_one_query_per_operator():
    names = [n for n in contract.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()


ROWS = {"op6": 110, "op7": 500, "op11": 500, "op13": None}


@pytest.mark.parametrize("name", [n for n in contract.queries() if n.startswith("op")])
def test_query_covers_its_table(spark, name):
    rows = contract.queries()[name](spark, str(SMALL)).count()
    expected = ROWS.get(name.partition("_")[0], 200)
    assert rows == expected if expected else rows > 0


def test_runs_from_any_folder(tmp_path):
    """Executors' Python gets the code with the query, not from where it runs."""
    code = (
        f"import sys; sys.path.insert(0, {str(contract.__file__).rpartition('/')[0]!r})\n"
        "from ledgerline.session import local_session\n"
        "spark = local_session(2, memory='2g')\n"
        "import __spark_entry__ as e\n"
        "for name in ('op10_nearest_centroid', 'op5_wu_manber', 'op2_bbit_minhash'):\n"
        f"    assert e.queries()[name](spark, {str(SMALL)!r}).count() == 200\n"
        f"assert e.queries()['pipeline'](spark, {str(SMALL)!r}).count() > 0\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
