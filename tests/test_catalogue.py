import pytest

from lodestar.plans import catalogue

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(catalogue.queries()[name](spark, sf_dir), sf_dir, catalogue.oracle_sql()[name])


def test_compact_slots_takes_all_papers(spark, sf_dir, monkeypatch):
    taken = []
    monkeypatch.setattr(catalogue.store, "compact_slots", taken.append)
    catalogue.queries()["compact_slots"](spark, sf_dir)
    assert taken[0].count() == catalogue.papers(spark, sf_dir).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(catalogue.queries()) <= set(e.queries())


def test_entry_without_llm(tmp_path):
    """The registry works when the optional subpackage and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{repo}/lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{repo}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'cosine_topk' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
