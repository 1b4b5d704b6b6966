"""The entry point without the numbered operators, and shared storage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from vellum import storage

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_numbered_operators(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'related_notes' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


class Cluster:
    """A session of a cluster without a shared folder."""

    class sparkContext:  # noqa: N801
        master, applicationId = "spark://host:7077", "x"

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    class conf:  # noqa: N801
        @staticmethod
        def get(name, other=None):
            return other


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        storage.shared_folder(Cluster)
