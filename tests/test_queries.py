"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from helpers import SF, assert_same

from sparkloom import plans

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_matches_its_sql(spark, name):
    df = plans.queries()[name](spark, SF)
    if name in plans.oracle_sql():
        assert_same(df, plans.oracle_sql()[name], SF)
    else:
        assert df.count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_optional_subpackage():
    code = "import sys\nsys.modules['corpus_pipeline'] = None\nsys.modules['sparkloom.llm'] = None\nimport __spark_entry__ as e\nassert 'bm25_topk' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
