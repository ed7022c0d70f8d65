"""What workers hold: free memory goes back after a task, and a comparison stays a small multiple of its sets."""

import gc
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pagelode.llm import common, shingles, simhash
from pagelode.llm.common import bounds

MB = 1 << 20
kept = []


class Rows:
    """Stands in for a DataFrame and for its groups: gives the function that Spark would run in a worker."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, run, schema):  # noqa: N802
        return run

    def applyInArrow(self, run, schema):  # noqa: N802
        return run


def resident():
    gc.collect()
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def held(result):
    """Takes 200 MB in pieces too small for maps of their own, the last of which stays: the rest is free, but below it."""
    pieces = [b"x" * 50_000 for _ in range(200 * MB // 50_000)]
    kept.append(pieces.pop())
    return result


@pytest.mark.parametrize("grouped", [False, True])
def test_workers_give_memory_back(spark, grouped):
    table = pa.table({"a": np.zeros(MB)})
    if grouped:
        run = common.arrow_groups(Rows(spark), held, "a double")
    else:
        run = common.arrow_map(Rows(spark), lambda batches: map(held, batches), "a double")
    before = resident()
    out = run(table) if grouped else sum(map(len, run(iter(table.to_batches()))))
    assert resident() - before < 100 * MB and (out is table if grouped else out == MB)


def test_comparison_is_a_small_multiple_of_its_sets():
    r = np.random.default_rng(1)
    base = np.sort(r.integers(0, 1 << 60, 1000))
    sets = [np.unique(np.concatenate([base[40:], r.integers(0, 1 << 60, 40)])) for _ in range(2000)]
    values, edges = np.concatenate(sets), bounds(np.array([len(s) for s in sets]))
    tracemalloc.start()
    label = shingles.similar(values, edges)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not label.any() and most < 4 * values.nbytes


def test_fingerprints_are_a_small_multiple_of_the_texts():
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 3000, 1000)).encode() for _ in range(500)]
    tracemalloc.start()
    simhash.fingerprints(texts, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * sum(map(len, texts))
