"""The driver's memory after a packing is found."""

import subprocess
import sys
from pathlib import Path

CODE = r"""
import re
import numpy as np
from terrasift.llm import packing

def mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

sizes = np.random.default_rng(1).lognormal(7.2, 0.5, 190000).astype(int) + 1
counts = np.bincount(np.concatenate((sizes % 2048, np.full((sizes // 2048).sum(), 2048))), minlength=2049)
counts[0] = 0
before = mb()
plan = getattr(packing, "planned", packing.complete)(counts, 2048)
placed = np.zeros(2049, np.int64)
for p in plan:
    for size, n in p.sizes:
        placed[size] += n * p.times
assert (placed == counts).all()
print(mb() - before)
"""


def test_search_leaves_no_memory_behind():
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True, timeout=300, check=True).stdout
    assert float(out) < 60
