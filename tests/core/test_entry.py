"""The registry without what the training-data operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_missing_dependency_leaves_the_other_queries():
    for name in ("tiktoken", "tokenizers", "public_tokenizers", "leafpress.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'k1_markdown' in q, any(x.startswith('op') for x in q), set(e.oracle_sql()) <= set(q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) >= 46 and out[1:] in (["True", "False", "True"], ["True", "True", "True"]), (name, out)
