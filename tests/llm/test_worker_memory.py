"""What stays in the executors' Python workers after a stage: they are kept for later stages, beside the heap."""

import os
import subprocess
import sys
from pathlib import Path

from tests.llm import corpus

ROOT = str(Path(__file__).resolve().parents[2])

#: MB that token_pieces' job leaves in a worker after 600,000 distinct words in rows of 300, and how many pieces it gave.
LEFT = """
import gc, re
import pyarrow as pa
from pathlib import Path
from captionlake.llm import packing as p

def private():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

def batches():
    for b in range(4):
        texts = [" ".join(f"w{(b * 500 + i) * 300 + k:x}" for k in range(300)) for i in range(500)]
        yield pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts)], names=["doc_id", "text"])

p._encoder(p.vocabulary_path(), p.ranks_path()).encode(["a few words"])
before = private()
pieces = sum(x.num_rows for x in p._pieces_job(p.vocabulary_path(), p.ranks_path(), 2048, False)(batches()))
gc.collect()
print(private() - before, pieces)
"""


def test_packing_leaves_little_in_a_worker():
    out = subprocess.run([sys.executable, "-c", LEFT], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True)
    left, pieces = out.stdout.split()
    assert int(pieces) == 2000 and float(left) < 70, out.stdout


def test_packing_starts_no_workers_for_its_patterns(spark, monkeypatch):
    """The table of patterns goes to the executors without a Python RDD, for which they would start workers of another kind."""
    from pyspark import SparkContext

    from captionlake.llm.packing import pack, token_pieces

    docs = corpus.docs(spark)

    def refused(*_, **__):
        raise AssertionError("a Python RDD")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    packed = pack(token_pieces(docs)).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in corpus.rows()} and max(r.offset + r.length for r in packed) <= 2048
