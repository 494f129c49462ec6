import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from graphloom import api
from graphloom.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_route_names_a_query():
    known = catalog.queries()
    assert all(name in known for values in api.ROUTES.values() for name in values.values())


def test_routers_suggest(spark):
    with pytest.raises(ValueError, match="did you mean 'callers'"):
        api.call(spark, "", "related", "calers")
    got = api.call(spark, "/root/testdata/sf0.001", "related", "neighbors", ["id"])
    assert got.columns == ["id"]


def test_works_without_the_training_data_parts(tmp_path):
    import shutil

    for name in ("graphloom", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "graphloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'neighbors_in' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
