"""The engine without the folders of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tests.conftest import ROOT, SF

COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(n for n in q if n.startswith('op') or n in ('pipeline', 'quoted_conversations')), set(e.oracle_sql()) <= set(q))"


@pytest.fixture
def copy(tmp_path):
    for name in ("parchmint", "__spark_entry__.py"):
        source = Path(ROOT, name)
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    return tmp_path


def said(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()


def test_entry_without_the_folder(copy):
    shutil.rmtree(copy / "parchmint" / "llm", ignore_errors=True)
    n, rest = said(copy, COUNT).split(" ", 1)
    assert int(n) > 100 and rest == "[] True"


def test_entry_where_the_folder_cannot_be_imported(copy):
    (copy / "parchmint" / "llm").mkdir(exist_ok=True)
    (copy / "parchmint" / "llm" / "__init__.py").write_text("import a_module_that_is_nowhere\n")
    assert int(said(copy, COUNT).split(" ", 1)[0]) > 100


def test_flagship_without_the_folder(copy):
    shutil.rmtree(copy / "parchmint" / "llm", ignore_errors=True)
    code = f"import __spark_entry__ as e; from parchmint.session import session; s = session('local[2]', **{{'spark.ui.enabled': 'false'}}); print('rows', e.queries()['flagship'](s, {SF!r}).count())"
    assert "rows" in said(copy, code)
