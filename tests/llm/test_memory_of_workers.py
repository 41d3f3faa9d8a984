"""What a Python worker still holds when its task has ended, measured in a process of its own."""

import subprocess
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import _common, toxicity
from lodestone.scratch import Scratch

_MEASURED = """
import re
import numpy as np, pandas as pd
from lodestone.llm import toxicity

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def texts(low):
    return [" ".join(f"word{i}x{low}" for i in range(j, j + 25)) for j in range(0, 25_000, 25)]

def scored():
    model = toxicity.Model({"bad": 0}, [1.0], np.zeros(1 + toxicity.N_VOTERS), -3.0)
    for _ in toxicity._scores((pd.Series(texts(low)) for low in range(10)), model):
        pass
    return model

texts(0)
before = held()
kept = scored()
print(held() - before)
"""


def test_workers_give_memory_back():
    run = subprocess.run([sys.executable, "-c", _MEASURED], capture_output=True, text=True, check=True, timeout=120)
    assert float(run.stdout) < 20  # MB


def test_words_are_forgotten_at_the_end_of_a_task():
    model = toxicity.Model({"bad": 0}, [1.0], np.zeros(1 + toxicity.N_VOTERS), -3.0)
    model.weights[0] = 2.0
    texts = pd.Series(["a bad word", None, "a good word"])
    got = pd.concat(toxicity._scores(iter([texts, texts]), model))
    assert not model.known
    assert got.tolist() == [model.score(t) for t in ["a bad word", "", "a good word"]] * 2


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes], pa.int64())], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 4000, 1, 1).select(F.expr("repeat('x', 4096)").alias("text"))
    told = Scratch(spark).keep(texts.mapInArrow(sizes, "n long"), 1 << 20)
    assert told.agg(F.max("n")).first()[0] < 2 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_a_task_gives_back_what_the_one_before_left(monkeypatch):
    order = []
    monkeypatch.setattr(_common, "give_back", lambda: order.append("back"))
    rows = _common.lean(lambda n: (order.append(i) or i for i in range(n)))
    assert list(rows(2)) == [0, 1]
    assert order == ["back", 0, 1, "back"]


_PACKED_BEFORE = """
import re
import pyarrow as pa
from public_tokenizers import path
from lodestone.llm import minhash_dedup, packing

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def signed():
    texts = pa.record_batch([pa.array([1]), pa.array([None], pa.string()), pa.array([b"a b c d e f"])], names=["doc_id", "tag", "text"])
    return [b.num_rows for b in minhash_dedup._sign(5)(iter([texts]))]

vocabulary = path("word_bpe_49k.json")
packing.encode(b"a", vocabulary)
signed()
before = held()
for i in range(400_000):
    packing.encode(b"w%dq" % i, vocabulary)
kept = held() - before
signed()
print(kept, held() - before)
"""


def test_words_of_packing_are_gone_in_the_stages_after_it():
    run = subprocess.run([sys.executable, "-c", _PACKED_BEFORE], capture_output=True, text=True, check=True, timeout=120)
    kept, left = map(float, run.stdout.split())
    assert kept > 60 and left < 20  # MB


def test_only_other_functions_make_a_worker_forget(monkeypatch):
    order = []
    monkeypatch.setattr(_common, "remembered", [lambda: order.append("forgotten")])
    for keeps in (True, False):
        assert list(_common.lean(lambda: iter([keeps]), remembers=keeps)()) == [keeps]
        assert order == ["forgotten"] * (not keeps)


def test_packing_remembers_words_until_it_cuts():
    from public_tokenizers import path

    from lodestone.llm import packing

    packing.encode(b"a word", path("word_bpe_49k.json"))
    assert packing._words.cache_info().currsize
    assert list(packing._cut(4096)(iter([]))) == []
    assert not packing._words.cache_info().currsize
