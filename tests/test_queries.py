import os

import pytest

import oracle
from tessera.plans import oracles, queries

@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_its_sql(spark, name):
    assert oracle.rows(queries.QUERIES[name](spark, oracle.SF)) == oracle.sql_rows(oracles.SQL[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


_RUN = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
found = e.queries()
print(found["w02_unambiguous_prompts"](spark, "/root/testdata/sf0.001").count() > 0, any(n.startswith("op") or n == "pipeline" for n in found))
"""


def test_a_fault_in_an_operator_is_not_an_absent_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("__pycache__"))
    (tmp_path / "tessera" / "llm").mkdir(exist_ok=True)
    (tmp_path / "tessera" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tessera" / "llm" / "queries.py").write_text("from tessera.llm.nowhere import nothing")
    (tmp_path / "corpus_pipeline.py").write_text("")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "tessera.llm.nowhere" in said.stderr


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", _RUN], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split()[-2:] == ["True", "False"], said.stderr
