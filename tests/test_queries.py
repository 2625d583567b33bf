"""Every registered query but those of the llm subpackage against its SQL, and the entry module without that subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from compare import assert_same, connect
from weftline.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_its_sql(spark, sf_dir, con, name):
    assert_same(catalogue.QUERIES[name](spark, sf_dir), con, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_find_by_text_against_brute_force(spark, sf_dir):
    from weftline.kernel import dom
    from weftline.kernel.dom import Page

    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in catalogue.QUERIES["find_by_text"](spark, sf_dir).collect():
        found = [x for x in dom.walk(Page(html[r["page_id"]]).posted()) if "the" in dom.tight_text(x)]
        assert r["first_node_id"] == (min(found, key=lambda x: x.post).pre if found else None)
        assert r["last_node_id"] == (found[-1].pre if found else None)


def test_entry_without_llm(tmp_path, sf_dir):
    """The driver removes the llm folders and the pipeline; the rest has to go on."""
    for name in ("weftline", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'links_default' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert out.returncode == 0, out.stderr


def test_filters_reach_the_scan(spark, sf_dir):
    from weftline.operators.extract import extract

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    df = extract(pages, {"title": "title::text"}, keep=["page_id"]).where("page_id = 3")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(page_id,3)" in plan and "url" not in plan.split("ReadSchema")[1].split("\n")[0]
