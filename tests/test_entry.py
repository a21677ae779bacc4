"""The entry module without the corpus operators, or without a package that they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["zstandard", "ahocorasick", "tokenizers", "public_tokenizers", "corpus_pipeline", "quarry.llm"])
def test_other_queries_exist_without(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as E\n"
        "names = E.queries()\n"
        "assert len(names) >= 106 and 'vector_search_l2' in names, len(names)\n"
        "assert set(E.oracle_sql()) <= set(names)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
