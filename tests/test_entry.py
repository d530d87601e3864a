import os
import subprocess
import sys

from conftest import ROOT

LEFT = """
import importlib, sys
{hide}
sys.path.insert(0, {root!r})
entry = importlib.import_module("__spark_entry__")
print(len(entry.queries()), len(entry.oracle_sql()), sum(n.startswith("op") or n == "pipeline" for n in entry.queries()))
"""
#: An import system in which a package is not there, whatever lies on the disk.
HIDE = """
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
"""


def found(*gone):
    code = LEFT.format(hide=HIDE.format(names=gone) if gone else "", root=ROOT)
    env = {**os.environ, "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=env).stdout
    return tuple(map(int, out.split()))


def test_entry_without_the_subpackage_or_the_pipeline():
    """With either or both away, all other queries stay."""
    from veilframe.plans.catalog import QUERIES
    from veilframe.plans.oracles import oracles

    whole = found()
    assert whole[0] >= len(QUERIES) and whole[1] >= len(oracles())
    for gone in (("veilframe.llm",), ("veilframe.llm", "corpus_pipeline")):
        assert found(*gone) == (len(QUERIES), len(oracles()), 0)
    if whole[2]:
        assert found("corpus_pipeline")[2] == whole[2] - 1
