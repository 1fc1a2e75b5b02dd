"""The driver's entry point, with and without the optional folders."""

import os
import shutil
import subprocess
import sys

import pytest

from cipherlode import runtime

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["cipherlode/llm", "tests/llm"], ["cipherlode/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_imports_without_the_optional_parts(tmp_path, gone):
    top = tmp_path / "repo"
    shutil.copytree(ROOT, top, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = top / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = f"import sys; sys.path.insert(0, {str(top)!r}); import __spark_entry__ as e; q = e.queries(); assert 'x01_scan_hits' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); assert e.__file__.startswith({str(top)!r})"
    # the original folder stays importable: what is gone must not be found there
    done = subprocess.run([sys.executable, "-c", code], cwd=top, env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


class Context:
    def __init__(self, master):
        self.master = master

    def getConf(self):  # noqa: N802
        return {}


class Session:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = Context(master), conf


def test_work_folder_is_shared():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.work_folder(Session("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.work_folder(Session("local-cluster[2,1,1024]"))
    assert runtime.work_folder(Session("yarn", **{"spark.checkpoint.dir": "hdfs:///work"})) == "hdfs:///work"
    assert runtime.work_folder(Session("local[2]")).startswith("file:///")


def test_stored_tables_can_be_discarded(spark):
    df = runtime.stored(spark.range(5), "five")
    path = df._cipherlode_path.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    runtime.discard(df)
    assert not os.path.exists(path)
    runtime.discard(spark.range(1))


def test_scratch_tables_go(spark):
    with runtime.scratch(spark) as keep:
        gone = runtime.stored(spark.range(3), "gone")
        with runtime.scratch(spark):
            inner = runtime.stored(gone.selectExpr("id + 1 as id"), "inner")
        kept = keep(runtime.stored(gone.selectExpr("id * 2 as id"), "kept"))
    paths = [os.path.isdir(d._cipherlode_path.removeprefix("file://")) for d in (gone, inner, kept)]
    assert paths == [False, False, True] and sorted(r.id for r in kept.collect()) == [0, 2, 4]
