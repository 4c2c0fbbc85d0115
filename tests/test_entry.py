"""The driver contract without the optional subpackage or the libraries it needs."""

import subprocess
import sys

import pytest

from conftest import ROOT

CODE = """
import sys
for name in {blocked!r}:
    sys.modules[name] = None
import __spark_entry__ as driver
found = driver.queries()
assert len(found) == {n} and set(driver.oracle_sql()) == set(found), sorted(found)
"""


@pytest.mark.parametrize(
    "blocked", [["xxhash"], ["public_tokenizers"], ["numpy"], ["pyarrow"], ["tilerank.llm"], ["corpus_pipeline"]]
)
def test_without_the_corpus_operators_the_others_stay(blocked):
    code = CODE.format(blocked=blocked, n=23)
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
