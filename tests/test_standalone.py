"""The library stands without the separate subpackage for training data, whether or not that is there."""

import subprocess
import sys
from pathlib import Path

import pytest

from quarrystone.functions.hashing import tree_digest

TOP = Path(__file__).resolve().parent.parent

CODE = """
import sys
from importlib.abc import MetaPathFinder

class Gone(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("quarrystone.llm"):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 100 and set(e.oracle_sql()) <= names and not any(n.startswith("op1") or n == "pipeline" for n in names), names
assert not [m for m in sys.modules if m.startswith("quarrystone.llm")]
"""


def test_entry_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=TOP, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_a_missing_library_is_told():
    code = CODE.replace('"corpus_pipeline" or name.startswith("quarrystone.llm")', '"ahocorasick"')
    done = subprocess.run([sys.executable, "-c", code], cwd=TOP, capture_output=True, text=True, timeout=120)
    assert done.returncode and "ahocorasick" in done.stderr


def test_nothing_outside_names_the_subpackage():
    for f in (TOP / "quarrystone").rglob("*.py"):
        if "llm" not in f.relative_to(TOP).parts:
            assert "quarrystone.llm" not in f.read_text() and ".llm" not in f.read_text(), f


def test_tree_digest():
    files = {"b/x": (0o644, b"1"), "a": (0o755, b""), "é": (0o644, b"\0")}
    assert tree_digest(files) == tree_digest(dict(reversed(files.items()))) == tree_digest({"é" if k == "é" else k: v for k, v in files.items()})
    assert tree_digest(files) != tree_digest(files | {"a": (0o644, b"")}) != tree_digest(files | {"a": (0o644, b"1")})
    for bad in ({"/a": (0o644, b"")}, {"a/../b": (0o644, b"")}, {"a": (0o777, b"")}, {"a": (0o644, b""), "a/b": (0o644, b"")}, {"é": (0o644, b""), "é": (0o644, b"")}):
        with pytest.raises(ValueError):
            tree_digest(bad)
