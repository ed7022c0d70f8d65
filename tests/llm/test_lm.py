"""The language model against a dictionary version, and its edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyarrow import fs

from pagelode.llm import lm, queries

TEXTS = ["the cat sat on the mat", "The cat ran", "a dog sat\non the\tmat mat", "", None, "zebra quagga", "the the the the", "cat sat on a mat, the cat", "on the mat the dog ran to the cat"] * 3


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\nend"]


def brute(rows, order=2):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows}
    train = [words(t) for d, t in rows if not held[d]]
    uni = Counter(w for t in train for w in t)
    counts = {k: Counter() for k in range(1, order + 1)}
    for t in train:
        line = ["\nbegin", *t]
        for k in range(2, order + 1):
            counts[k].update(g for i in range(len(line) - k + 1) if k == order or i == 0 for g in [tuple(line[i : i + k])])
    for k in range(order, 1, -1):  # below the order: distinct words before
        counts[k - 1].update(g[1:] for g in counts[k])
    off = {k: lm.discounts([sum(c == n for c in counts[k].values()) for n in (1, 2, 3, 4)]) for k in counts}
    total, free = {}, {}
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            free[g[:-1]] = free.get(g[:-1], 0.0) + off[k][min(c, 3) - 1]
    n, v = sum(uni.values()), len(uni)
    rest = sum(off[1][min(c, 3) - 1] for c in counts[1].values())

    def less(k, c):
        return max(c - off[k][min(c, 3) - 1], 0) if c else 0

    def p(context, w):
        if not context:
            return (less(1, counts[1][(w,)]) + rest / (v + 1)) / max(len(counts[2]), 1)
        lower = p(context[1:], w)
        if not total.get(context):
            return lower
        return less(len(context) + 1, counts[len(context) + 1][(*context, w)]) / total[context] + free[context] / total[context] * lower

    for context in [("\nbegin",), ("the",), ("never",), ("\nbegin", "the"), ("the", "cat"), ("on", "the", "mat")]:  # a distribution over known words and one unknown
        if len(context) < order:
            assert math.isclose(sum(p(context, w) for w in uni) + p(context, "\nunknown"), 1.0, rel_tol=1e-9)
    out = []
    for d, t in rows:
        tokens = words(t)
        line = ["\nbegin", *tokens]
        own = sum(math.log10(p(tuple(line[max(i + 2 - order, 0) : i + 1]), w)) for i, w in enumerate(tokens))
        out.append((d, held[d], len(tokens), sum(uni[w] > 0 for w in tokens), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tokens), own))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_against_dictionaries(spark, order):
    rows = [*enumerate(TEXTS), (None, "the cat"), (3, "the dog sat")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string").repartition(3)
    key = lambda r: tuple((x is None, x) for x in r[:3]) + tuple(r[3:])
    found = sorted((tuple(r)[:7] for r in lm.score(spark, df, order).collect()), key=key)
    wanted = sorted(brute(rows, order), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in wanted], rtol=1e-9)


def test_no_training_and_no_rows(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    row = lm.score(spark, spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == pytest.approx(0.0)
    assert lm.score(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm.unmix(lm.mix(keys)) == keys).all()
    a, b = keys[::2], keys[::3]
    got, (sums,) = lm.merge_blocks([lm.pack_block(a, [np.full(len(a), 2)]), lm.pack_block(b, [np.full(len(b), 5)])], 1)
    assert got.tolist() == sorted({*a.tolist(), *b.tolist()}) and sums.sum() == 2 * len(a) + 5 * len(b)


def test_query_takes_five_words(spark):
    """The registered query's scores are those of the model of order five, held out and training texts alike."""
    found = {r.doc_id: r for r in queries.op7_kneser_ney(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert lm.ORDER == 5 and len(found) == len(rows)
    for d, held, n, known, total, base, own in brute(rows, 5):
        r = found[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(own)


def test_parts_off_mounted_folders(tmp_path, monkeypatch):
    lm.write_parts(f"file://{tmp_path}/parts", np.array([3, 9, 1 << 33]), [b"ab", b"", b"cde"])
    wanted = [b"ab", b"", b"cde"]
    assert [lm.Shelf(str(tmp_path)).part("parts", i) for i in (3, 9, 1 << 33)] == wanted
    monkeypatch.setattr(lm, "open_fs", lambda uri: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "parts"))
    shelf = lm.Shelf("elsewhere")
    assert [shelf.part("parts", i) for i in (3, 9, 1 << 33)] == wanted and not shelf.maps
