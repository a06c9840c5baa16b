"""What a Python worker still holds when its task is over."""

import subprocess
import sys

CODE = r"""
import re
import pyarrow as pa
from loamworks.llm import common, minhash

def held():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

def batches():
    for k in range(2):
        yield pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([f"w{k}{i} " * 700 + str(i) for i in range(4000)])], ["doc_id", "text"])

def task():
    for _ in RUN(batches()):
        pass

task()  # tables of powers are made once, and stay
common.give_back()
least = held()
for _ in range(2):
    task()
print(held() - least)
"""


def kept(run: str) -> int:
    return int(subprocess.run([sys.executable, "-c", CODE.replace("RUN", run)], capture_output=True, text=True, check=True).stdout)


def test_a_worker_gives_back_what_it_freed():
    assert kept("minhash._sketches") > 30  # MB
    assert kept("common.lean(minhash._sketches)") < 16
