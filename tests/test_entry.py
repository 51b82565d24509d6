import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r["scope"] for r in rows} == {"id", "ood", "global"}


def test_a_missing_library_of_the_subpackage_costs_its_queries_only():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 50 and out[1] == "False" and int(out[2]) > 45
