"""The driver contract, also without a session and without the optional operators."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_needs_no_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=REPO, capture_output=True, text=True, check=True)
    n, m, subset = out.stdout.split()
    assert int(n) >= 95 and int(m) >= 85 and subset == "True"


def test_import_without_optional_operators(tmp_path):
    for name in os.listdir(REPO):
        if name not in ("corpus_pipeline.py", "tests", ".git", "tessera"):
            os.symlink(f"{REPO}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "tessera")
    for name in os.listdir(f"{REPO}/tessera"):
        if name != "llm":
            os.symlink(f"{REPO}/tessera/{name}", tmp_path / "tessera" / name)
    code = "import shutil, sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', './entry.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(sum(n[:2] == 'op' for n in m.queries()), 'stats_by_split' in m.queries())"
    (tmp_path / "entry.py").write_text(open(f"{REPO}/__spark_entry__.py").read())
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0 and out.stdout.split()[-2:] == ["0", "True"], out.stderr


def test_files_of_tests_have_names_of_their_own():
    """Of two files with one name, pytest runs only the first."""
    names = [f for _, _, files in os.walk(f"{REPO}/tests") for f in files if f.startswith("test_") and f.endswith(".py")]
    assert len(names) == len(set(names))


def test_entry(spark):
    sys.path.insert(0, REPO)
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
