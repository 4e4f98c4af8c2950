import importlib
import sys


def test_entry_imports_without_the_optional_folder(monkeypatch):
    import __spark_entry__ as e

    assert e.queries()["monthly_trend"]
    for name in [m for m in sys.modules if m.startswith("tillwright.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(e)
    assert bare.queries() and not any(k.startswith("op1") or k == "pipeline" for k in bare.queries())
    monkeypatch.undo()
    importlib.reload(e)


def test_entry_runs(spark):
    import os

    import __spark_entry__ as e

    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
