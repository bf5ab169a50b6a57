import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(('framewright.llm', 'corpus_pipeline')):
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
assert e.queries() and not any(q.startswith('op') for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_llm_subpackage():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=120)


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_faults_inside_the_subpackage_are_not_hidden(tmp_path):
    code = CODE.replace("('framewright.llm', 'corpus_pipeline')", "'framewright.llm.topk'").split("assert")[0].replace("import __spark_entry__ as e", "import __spark_entry__ as e\ntry:\n    e.queries()\nexcept ImportError:\n    sys.exit(0)\nsys.exit(1)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_where_only_compiled_files_are_left(tmp_path):
    """The folder is gone but for what Python left in it."""
    import shutil

    for name in ("__spark_entry__.py", "framewright"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "framewright/llm")
    (tmp_path / "framewright/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
