"""Every registered query against its SQL on the smallest tables, and the entry points without the llm folders."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from convoke import queries as core

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def plain(rows, names):
    return sorted(tuple(f"{r[n]:.9g}" if isinstance(r[n], float) else str(r[n]) for n in sorted(names)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    frame = __spark_entry__.queries()[name](spark, SF)
    rows = [r.asDict() for r in frame.collect()]
    if name not in core.ORACLES:
        assert rows
        return
    found = duck.execute(core.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    assert plain(rows, names) == plain([dict(zip(names, r, strict=True)) for r in found.fetchall()], names)


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_folders(tmp_path):
    """The other queries stay when the subpackage and the pipeline are gone; other import errors are told."""
    shutil.copytree(f"{ROOT}/convoke", tmp_path / "convoke", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert run().stdout.split() == [str(len(core.QUERIES)), "False", str(len(core.ORACLES))]
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in run().stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/convoke"):
        if "llm" not in folder.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert not re.search(r"^\s*(from|import)\b.*\bllm\b", f.read(), re.M), n
