"""The driver's entry module in a process of its own."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# Opening any jar, as a checker whose Spark lives elsewhere would see it, is an error.
SCRIPT = """
import builtins, glob, zipfile
def refuse(*a, **k):
    raise FileNotFoundError("no jar here")
zipfile.ZipFile = refuse
glob.glob = lambda *a, **k: []
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert len(names) >= 64 and set(sql) <= set(names)
print("IMPORTED")
"""


def test_entry_needs_no_jar():
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=ROOT, capture_output=True, text=True)
    assert "IMPORTED" in done.stdout, done.stderr[-2000:]
