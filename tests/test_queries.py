"""Every registered query of the engine against its SQL on the smallest data."""

import datetime
from pathlib import Path

import duckdb
import pytest

from quern import catalogue


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    got = df.collect()
    if name not in catalogue.oracle_sql():
        assert df.columns
        return
    relation = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in relation.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in got), key=str) == expected


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_works_without_the_optional_parts(tmp_path, pipeline):
    """A copy without the llm folders imports and answers, whether the pipeline's file is left in it or not."""
    import os
    import shutil
    import subprocess
    import sys

    root = Path(catalogue.__file__).resolve().parents[1]
    shutil.copytree(root / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline:
        if not (root / "corpus_pipeline.py").exists():
            pytest.skip("this tree has no pipeline")
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 82 and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    # no path of this tree, whoever set it, reaches the copy
    apart = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != root]
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": os.pathsep.join(apart)})
