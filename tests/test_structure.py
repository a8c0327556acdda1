"""What the repository must keep to."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1]
CORE = [p for p in (ROOT / "siltstone").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]


def test_nothing_imports_the_text_operators():
    assert not [p for p in CORE if re.search(r"siltstone\.llm|from siltstone import llm", p.read_text())]


def test_no_local_checkpoints_or_cross_joins():
    for p in (ROOT / "siltstone").rglob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin", p.read_text()), p


def test_written_tables_can_be_cleared(spark, monkeypatch):
    from siltstone.session import clear, local_path, materialize

    monkeypatch.setattr("siltstone.session._made", {})  # only what this test writes
    df = materialize(spark.range(3).toDF("n"))
    path = local_path(df.inputFiles()[0])
    assert df.count() == 3 and pathlib.Path(path).exists()
    assert clear(spark) == 1 and not pathlib.Path(path).exists() and clear(spark) == 0
