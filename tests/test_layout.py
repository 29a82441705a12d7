import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_corpus_operators():
    for path in [*ROOT.glob("semloom/**/*.py"), *ROOT.glob("*.py")]:
        part = path.relative_to(ROOT).as_posix()
        if not part.startswith("semloom/llm/") and part not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert not re.search(r"^\s*(from|import)\s+[.\w]*\bllm\b", path.read_text(), re.M), part


def test_no_local_checkpoints_or_cross_machine_folders():
    for path in ROOT.glob("semloom/**/*.py"):
        assert "localCheckpoint(" not in path.read_text(), path
