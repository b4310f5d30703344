"""The driver's entry, with and without the corpus operators."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_corpus_operators():
    code = "import sys\nsys.modules['reelcheck.llm'] = None\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq, o = e.queries(), e.oracle_sql()\nassert len(q) > 90 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q), len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_every_oracle_has_its_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "reelcheck").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text(encoding="utf-8")), path
