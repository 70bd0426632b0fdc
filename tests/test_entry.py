"""The driver's entry module imports without looking at the installation of Spark, and whole."""

import subprocess
import sys
from pathlib import Path

from pyspark.ml.feature import StopWordsRemover

import registry
from registry.base import ENGLISH_STOP_WORDS

ROOT = Path(__file__).resolve().parent.parent
#: A file of any jar, and any folder of jars, is out of reach while the module is imported.
SEALED = """
import glob, os, pathlib, sys, zipfile
import pyspark
def refuse(*a, **k): raise AssertionError("import looked for files")
zipfile.ZipFile = refuse
pathlib.Path.glob = pathlib.Path.iterdir = pathlib.Path.rglob = lambda self, *a: iter(())
glob.glob = lambda *a, **k: []
import __spark_entry__ as e
import registry
assert not registry.FAILED, registry.FAILED
print(len(e.queries()), len(e.oracle_sql()))
"""


def test_every_group_is_loaded():
    assert registry.FAILED == {}


def test_imports_without_files_of_spark():
    out = subprocess.run([sys.executable, "-c", SEALED], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles = map(int, out.stdout.split())
    assert queries >= oracles > 100


def test_stated_stop_words_are_those_of_spark(spark):
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_one_broken_group_leaves_the_others(monkeypatch):
    monkeypatch.setattr(registry, "MODULES", ("relations", "no_such_group"))
    monkeypatch.setattr(registry, "FAILED", {})
    import warnings
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        queries, _ = registry.load()
    assert "no_such_group" in registry.FAILED and len(seen) == 1
    assert "a1_risk_distribution" in queries
