"""The driver contract, also without the corpus operators."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_and_sql():
    names, sql = entry.queries(), entry.oracle_sql()
    assert "search" in names and set(sql) <= set(names)


def test_names_need_no_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], capture_output=True, text=True, cwd=entry._ROOT)
    assert int(out.stdout.split()[-1]) > 50, out.stderr


def test_import_without_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert not [k for k in q if k.startswith('op') and k[2].isdigit()] and 'search' in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry._ROOT).returncode == 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
