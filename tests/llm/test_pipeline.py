"""The pipeline against a plain version, stage by stage on the same input, and whole."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from pagelode.llm import quality

from .test_operators import WORD, encoded, lower
from .test_shingles import wanted_labels


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output rows, from the smallest test table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out.append(spark.createDataFrame(stage(spark, out[-1], "").toPandas(), docs.schema))
    return out


def test_columns(stages):
    assert all(d.columns == corpus_pipeline.COLUMNS for d in stages) and len(corpus_pipeline.STAGES) == 5


def test_quality_stage(stages):
    verdict = {r.doc_id for r in quality.compression_bands(stages[0]).where("kept").collect()}
    assert rows_of(stages[1]) == Counter({k: v for k, v in rows_of(stages[0]).items() if k[0] in verdict}) and 0 < len(verdict) < 200


def test_line_stage(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders: dict[str, set] = {}
    for d, t in before.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(d)
    wanted = {d: "\n".join(x for x in t.split("\n") if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != d)) for d, t in before.items()}
    after = {r.doc_id: r for r in stages[2].collect()}
    assert {d: r.text for d, r in after.items()} == wanted and all(r.n_chars == len(r.text) for r in after.values())


def test_near_duplicate_stage(stages):
    """By five-word shingles at a similarity of 0.8, as a pipeline stage is to be (this test used to ask for op2's two bits, which bind that query only)."""
    label = wanted_labels({r.doc_id: r.text for r in stages[2].collect()})
    assert {r.doc_id for r in stages[3].collect()} == set(label.values()) and len(set(label.values())) < len(label)


def test_mixing_stage(stages):
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    taken = Counter()
    for r in stages[4].collect():
        assert r.text in texts[r.doc_id]
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert all(taken[d] <= 3 * len(WORD.findall(t)) for d, t in texts.items())
    assert sum(taken.values()) == pytest.approx(sum(len(WORD.findall(t)) for t in texts.values()), rel=0.03)


def test_packing_stage(spark, stages):
    pieces = corpus_pipeline.pack_sequences(spark, stages[4], "").collect()
    assert sum(p.length for p in pieces) == sum(len(encoded(r.text)) for r in stages[4].collect())
    fill = Counter()
    for p in pieces:
        fill[p.sequence_id] += p.length
    assert all(fill[s] == 4096 for s in range(max(fill))) and len(fill) == max(fill) + 1


def test_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "fragment"]
    rows = found.collect()
    lengths = np.array([r.length for r in rows])
    assert len({(r.doc_id, r.fragment, r.start) for r in rows}) == len(rows)  # the mixture has several rows of a document
    assert len(lengths) and lengths.max() <= 4096 and re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])
