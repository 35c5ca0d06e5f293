"""The driver's contract, and the queries against their SQL on the smallest tables where these are there."""

import glob
import importlib
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from emberline import queries as base

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_names():
    assert set(base.oracle_sql()) <= set(base.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_imports_without_the_corpus_part(tmp_path):
    shutil.copytree(f"{ROOT}/emberline", tmp_path / "emberline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'site_linkage' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


@pytest.mark.parametrize("lost, kept", [("corpus_pipeline", "op"), ("public_tokenizers", "")])
def test_what_is_not_installed_is_left_out_alone(lost, kept):
    if not os.path.isdir(f"{ROOT}/emberline/llm") or not os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        pytest.skip("the corpus part is not here")
    code = f"import sys; sys.modules['{lost}'] = None; import __spark_entry__ as e; q = e.queries(); assert 'site_linkage' in q and 'pipeline' not in q and any(n.startswith('op') for n in q) == bool('{kept}')"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, check=True)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    got = base.queries()[name](spark, DATA)
    want = duck.execute(base.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def test_entry(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    importlib.reload(entry)
    assert entry.entry(spark).count() > 0
