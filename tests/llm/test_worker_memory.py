"""What a Python worker keeps of words it has met is bounded."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
GROWTH = """
import gc, re
from tensorloom.llm import quality, tokens
def mb():
    gc.collect()
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
def words(lo):
    return [f"w{i * 2654435761 % 2**32:x}" for i in range(lo, lo + 1000)]
WORK
before = mb()
for lo in range(0, 390_000, 1000):
    work(words(lo))
print(mb() - before)
"""
WORK = {
    "quality": "work = quality._hashed",
    "tokens": "t = tokens.WordTokenizer(tokens.vocabulary())\nwork = lambda x: t.encode([' '.join(x)])",
}


@pytest.mark.parametrize(("name", "most"), [("quality", 40), ("tokens", 50)])
def test_new_words_do_not_pile_up(name, most):
    got = subprocess.run([sys.executable, "-c", GROWTH.replace("WORK", WORK[name])], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")})
    assert float(got.stdout.split()[-1]) < most
