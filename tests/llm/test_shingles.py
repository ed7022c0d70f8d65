"""Near-duplicates by shingle sets against a plain version."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa

from pagelode.llm import shingles
from pagelode.llm.common import bounds

from .test_operators import documents, fingerprint, labels, lower, some_texts


def shingle_set(text, width=5):
    words = [w for w in lower(text or "").translate(dict.fromkeys(b"\t\n\x0b\x0c\r", " ")).split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def wanted_labels(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    close = lambda a, b: a == b or (a | b and len(a & b) / len(a | b) >= 0.8)
    return labels(sets, [(i, j) for i in sets for j in sets if j < i and close(sets[i], sets[j])])


def edited(seed=3, groups=40):
    """Texts and copies of them with some words changed, around a similarity of 0.8 and some SimHash bits apart."""
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([60, 200, 500]))]
        for changes in (0, len(words) // 100, len(words) // 50, len(words) // 30):
            copy = list(words)
            for at in r.sample(range(len(words)), changes):
                copy[at] = f"x{r.randrange(3000)}"
            out.append(" ".join(copy))
    return out


def test_shingles_agree(spark):
    texts = [*some_texts(), *edited(), "a b c d", "A  b\nc d", "a b c"]
    found = {r.doc_id: r.component_id for r in shingles.near_duplicates(spark, documents(spark, texts)).collect()}
    assert found == wanted_labels(dict(enumerate(texts)))
    assert shingles.near_duplicates(spark, documents(spark, [])).collect() == []
    repeated = shingles.near_duplicates(spark, documents(spark, ["a b c", "a b c", "z"], ids=[None, 4, 4])).collect()
    assert Counter((r.doc_id, r.component_id) for r in repeated) == Counter({(None, 4): 1, (4, 4): 2})


def test_similar_counts_in_parts(monkeypatch):
    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(50, 150), np.arange(200, 201), np.arange(52, 152)]
    monkeypatch.setattr(shingles, "COUNTED", 7)
    assert shingles.similar(np.concatenate(sets), bounds(np.array([len(s) for s in sets]))).tolist() == [0, 0, 2, 3, 2]


def test_similar_in_any_order():
    """A component that is outgrown by another is still held against it: 0 and 1 are the largest first, 2, 3 and 4 then."""
    r = random.Random(7)
    for begins in ([0, 10, 30, 40, 20], *(r.sample(range(0, 400, 10), 30) for _ in range(50))):
        sets = [np.arange(a, a + 100) for a in begins]
        want = labels(dict(enumerate(begins)), [(i, j) for i, a in enumerate(begins) for j, b in enumerate(begins) if j < i and abs(a - b) <= 10])
        assert shingles.similar(np.concatenate(sets), bounds(np.array([100] * len(sets)))).tolist() == [want[i] for i in range(len(begins))]


def test_keys_of_equal_sets_are_equal():
    hashes, edges = shingles.shingle_hashes(pa.array(["a b c d e f", None, "A b C d e f\n", "a b"]))
    keys = shingles.bucket_keys(hashes, edges)
    assert np.diff(edges).tolist() == [2, 0, 2, 1] and (keys[0] == keys[1]).all() and (keys[0] != keys[2]).all()


def test_stage_takes_edited_copies(spark):
    """The pipeline's stage drops copies that are more than two SimHash bits away."""
    texts = edited()
    label = wanted_labels(dict(enumerate(texts)))
    apart = [i for i, t in enumerate(texts) if label[i] != i and (fingerprint(t) ^ fingerprint(texts[label[i]])).bit_count() > 2]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, texts), "").collect()}
    assert len(apart) > 20 and kept == set(label.values())


def test_fingerprints_propose(spark, monkeypatch):
    """Pairs that no bucket holds are found by their SimHash fingerprints; the sets still decide."""
    r = random.Random(5)
    words = [f"w{r.randrange(9000)}" for _ in range(3000)]
    texts = [" ".join(words), " ".join([*words[:1500], "x", *words[1501:]]), " ".join(words[::-1])]
    monkeypatch.setattr(shingles, "bucket_keys", lambda hashes, edges: np.frombuffer(random.randbytes(160 * (len(edges) - 1)), np.uint64).reshape(-1, 20))
    found = {x.doc_id: x.component_id for x in shingles.near_duplicates(spark, documents(spark, texts)).collect()}
    assert found == wanted_labels(dict(enumerate(texts))) == {0: 0, 1: 0, 2: 2}
