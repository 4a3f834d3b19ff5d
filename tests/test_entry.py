"""The driver's view: registration, the flagship query and a sample of oracles at the smallest scale."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_every_oracle_has_a_query():
    from oracles import ORACLES
    assert set(ORACLES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_rest_stands_without_the_text_folders(tmp_path, also):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *also)
    shutil.copytree(here, tmp_path / "tree", ignore=skip)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and not [n for n in q if n.startswith('op1') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "tree", check=True, timeout=120)


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["src_ip", "flood_proto", "episode_start", "trip_ts", "reason", "correlated"]
    assert df.count() > 0


@needs_data
@pytest.mark.parametrize("name", ["flood_trips", "tea_verdict", "score_decisions", "attach_reputation", "ttl_dedupe", "resolve_policy", "ip_dossier", "live_deltas"])
def test_oracle(spark, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert difference(got, connect(SMALL).execute(entry.oracle_sql()[name]).df()) is None
