"""The driver contract, and that the library stands without the training-data subpackage."""

import subprocess
import sys

import __spark_entry__ as entry
from conftest import ROOT
from snapledger.plans import catalogue


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "opening_count" in df.columns


def test_nothing_else_imports_the_subpackage():
    own = [f for f in (ROOT / "snapledger").rglob("*.py") if "llm" not in f.relative_to(ROOT).parts]
    assert not [f for f in own if "snapledger.llm" in f.read_text()]


def test_entry_without_the_subpackage(tmp_path):
    code = (
        "import sys, importlib.util as u\n"
        "real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith('snapledger.llm') else real(n, *a)\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'feed_recent' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')], q\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
