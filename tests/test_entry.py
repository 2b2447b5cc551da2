import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

TOP = Path(entry.__file__).resolve().parent


def test_every_query_of_the_catalogue_has_sql():
    from factloom.plans.catalogue import QUERIES, SQL

    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries())


def test_the_entry_imports_without_the_training_data_operators(tmp_path):
    for with_pipeline in (False, True):
        copy = tmp_path / str(with_pipeline)
        shutil.copytree(TOP / "factloom", copy / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(TOP / "__spark_entry__.py", copy)
        if with_pipeline and (TOP / "corpus_pipeline.py").exists():
            shutil.copy(TOP / "corpus_pipeline.py", copy)
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
