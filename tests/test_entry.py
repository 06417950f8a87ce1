from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_core_queries_without_the_text_operators(tmp_path):
    """With the text operators' folders gone, with corpus_pipeline.py or without it, the entry points give the core queries."""
    from catchment import model_queries, queries

    for name in ("catchment", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    ask = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    for _ in range(2):
        run = subprocess.run([sys.executable, "-B", "-c", ask], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
        names, sql = run.stdout.splitlines()
        assert names.split() == sorted(queries.QUERIES | model_queries.QUERIES) and sql.split() == sorted(queries.ORACLE_SQL | model_queries.ORACLE_SQL)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_a_shared_folder_must_be_named_on_a_cluster():
    import pytest

    from catchment.sources import shared

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)
