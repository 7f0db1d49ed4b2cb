"""The rest of the package does not depend on the training-data subpackage."""

from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_subpackage():
    for path in (ROOT / "tallyrack").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.MULTILINE), path


def test_entry_points():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "strain_index" in queries and set(sql) <= set(queries)
