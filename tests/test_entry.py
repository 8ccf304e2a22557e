import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(*missing):
    """queries() of a fresh interpreter in which these modules can't be imported."""
    code = f"import sys; sys.modules.update(dict.fromkeys({missing!r})); import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split())


def test_engine_queries_need_no_optional_package():
    engine = names("siftline.llm", "corpus_pipeline")
    assert len(engine) >= 45 and "regex_lines_literal" in engine and not [n for n in engine if n.startswith("op") or n == "pipeline"]
    assert names("ahocorasick", "tokenizers", "xxhash") == engine


def test_the_package_offers_its_interface():
    import siftline

    assert all(hasattr(siftline, name) for name in siftline.__all__) and callable(siftline.search) and siftline.Index.open
