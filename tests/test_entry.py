import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_and_oracles_are_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "lane_linearity" in entry.queries()


def test_rest_does_not_need_the_training_data_operators(tmp_path):
    """With the subpackage and the pipeline gone, the entry point still imports."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    package = tmp_path / "lanemill"
    package.mkdir()
    for path in (ROOT / "lanemill").iterdir():
        if path.name not in ("llm", "__pycache__"):
            (package / path.name).symlink_to(path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bbox' in q and not any(x.startswith(('op', 'lm_', 'secret', 'spot')) for x in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
