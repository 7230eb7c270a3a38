"""The package and the entry work where the text operators and the pipeline are absent."""

import shutil
import subprocess
import sys
from pathlib import Path


def test_entry_imports_without_them(tmp_path):
    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "tensorloom", tmp_path / "tensorloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    if (repo / "corpus_pipeline.py").exists():
        # With the folder gone the pipeline's module may still lie there: nothing imports it then.
        shutil.copy(repo / "corpus_pipeline.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, m, text = said.stdout.split()[-3:]
    assert int(n) >= int(m) > 50 and text == "False"


def test_a_query_runs_without_them(tmp_path, sf_dir):
    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "tensorloom", tmp_path / "tensorloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = f"""
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", e.queries()["tn_edges"](spark, {sf_dir!r}).count(), e.entry(spark).count())
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert said.returncode == 0, said.stderr[-2000:]
    assert all(int(n) > 0 for n in said.stdout.split("rows")[1].split())
