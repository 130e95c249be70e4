import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_llm_and_pipeline():
    out = run("import sys; sys.modules['strataq.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in q); print('fine')")
    assert out.stdout.strip() == "fine", out.stderr


def test_other_missing_modules_are_errors():
    out = run("import sys; sys.modules['duckdb_of_no_kind'] = None; sys.modules['strataq.sources'] = None; import __spark_entry__")
    assert out.returncode != 0
