"""The registered queries without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k[:2] == 'op' or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [["glyphmill/llm"], ["glyphmill/llm", "corpus_pipeline.py"]])
def test_imports_without_llm(tmp_path, gone):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", "tests", "*.md", "*.json")
    shutil.copytree(ROOT, copy, ignore=lambda d, names: skip(d, names) | {n for n in names if str((Path(d) / n).relative_to(ROOT)) in gone})
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    count, dealt, sound = out.stdout.split()
    assert int(count) > 150 and dealt == "False" and sound == "True"


def test_library_does_not_import_llm():
    for path in [*ROOT.glob("glyphmill/**/*.py"), *ROOT.glob("catalog/*.py")]:
        if "llm" not in path.parts:
            assert "glyphmill.llm" not in path.read_text(), path
