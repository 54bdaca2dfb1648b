"""What the entry file does when the subpackage of training-data operators is away, or broken."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()))"


def run(folder):
    return subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})


def copied(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    for name in ("checks", "tabulyse"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
    return tmp_path


def test_without_the_subpackage_the_other_queries_remain(tmp_path):
    folder = copied(tmp_path)
    shutil.rmtree(folder / "tabulyse" / "llm", ignore_errors=True)
    (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    from checks.queries import QUERIES

    assert run(folder).stdout.split()[-2:] == [str(len(QUERIES)), "0"]


def test_a_broken_import_is_told(tmp_path):
    folder = copied(tmp_path)
    broken = folder / "tabulyse" / "llm" / "queries.py"
    broken.parent.mkdir(exist_ok=True)
    (broken.parent / "__init__.py").touch()
    broken.write_text("import no_such_module\n")
    (broken.parent / "oracle.py").write_text("ORACLE = {}\n")
    done = run(folder)
    assert done.returncode and "no_such_module" in done.stderr
