"""Every operator and stage on the same awkward rows: nulls, empty and very long texts, ties, repeated rows, ids that are texts, clashing names, no rows."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelode.llm import ann, common, linededup, lm, mixing, packing, quality, queries, sharding, shingles, simhash, tokenfiles, tokens, warc

#: Names that operators use inside, or return.
CLASHING = ("_id", "_drops", "_pieces", "_row", "_key", "key", "tie", "then", "rest", "drops", "pieces", "own", "id", "ids", "h1", "fp", "node", "least", "label", "row", "number", "part", "before", "n", "size", "bytes", "digest", "first", "leaves", "slot", "hash", "vec", "a.b", "held_out", "n_lines", "ratio")
SHARED = "This line of more than twenty letters is shared"
LONG = " ".join(f"w{i % 977}" for i in range(200_000))


def rows(kind):
    own = (lambda i: i) if kind == "long" else (lambda i: None if i is None else f"id {i}/é")
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, f"{SHARED}\nown"), (6, f"{SHARED}\nother"), (7, f"x\n{SHARED}"), (None, f"{SHARED}\nof no id"), (None, "again none"), (8, "tied words here"), (9, "tied words here"), (10, "repeated row"), (10, "repeated row"), (10, "repeated id")]
    return [(own(i), t, None if n % 3 == 0 else "en", (None, "a", "b")[n % 3], 0) for n, (i, t) in enumerate(texts)]


def table(spark, kind, empty=False):
    df = spark.createDataFrame([] if empty else rows(kind), f"doc_id {kind}, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *(F.lit("c").alias(c) for c in CLASHING))


def as_pages(df):
    return df.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})


def key(r):
    return tuple((x is not None, x) for x in r)


def pairs(found, *columns):
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key)


def check_warc(spark, df, given):
    found = warc.read_warc(spark, warc.write_warc(spark, as_pages(df)))
    big = max((i for i, t, *_ in given if t == LONG), default=None, key=str)
    wanted = sorted(((i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), "response", None) for i, t, *_ in given), key=key)
    assert pairs(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == wanted and (big is None or len(LONG) > 1000)


def check_simhash(spark, df, given):
    found = simhash.near_duplicates(spark, df)
    assert Counter(r.doc_id for r in found.collect()) == Counter(i for i, *_ in given)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in found.collect()}
    if given:
        assert {by[given[n][0], "0" * 16] for n in range(3)} == {given[0][0]} and by[given[10][0], simhash_of("tied words here")] == given[9][0]


def simhash_of(text):
    return f"{int(simhash.fingerprints([text.encode()])[0]):016x}"


def check_lines(spark, df, given):
    found = linededup.dedup_lines(spark, df)
    assert set(CLASHING) <= set(found.columns) and len(found.columns) == len(df.columns) + 1  # n_lines is replaced, n_dropped added
    keeper = max((i for i, t, *_ in given if SHARED in (t or "") and i is not None), default=None)
    wanted = []
    for i, t, *_ in given:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x != SHARED or i == keeper]
        wanted.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert pairs(found, "doc_id", "text", "n_lines", "n_dropped") == sorted(wanted, key=key)


def check_packing(spark, df, given):
    found = packing.pack(spark, df, length=512)
    sizes = Counter()
    for r in found.collect():
        sizes[r.doc_id] += r.length
    wanted = Counter()
    for i, t, *_ in given:
        wanted[i] += len(library(t))
    assert sizes == wanted


def library(text, cache={}):  # noqa: B006
    from tokenizers import Tokenizer

    if "t" not in cache:
        cache["t"] = Tokenizer.from_file(tokens.default_vocabulary())
    if text not in cache:
        cache[text] = [*cache["t"].encode(text or "", add_special_tokens=False).ids, 2]
    return cache[text]


def check_files(spark, df, given):
    found = tokenfiles.read_token_files(spark, tokenfiles.write_token_files(spark, df)).orderBy("start").collect()
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found), key=lambda x: (str(x[0]), x[1])) == sorted(((i, library(t)) for i, t, *_ in given), key=lambda x: (str(x[0]), x[1]))
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])][: len(found)]
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i if i is not None else 0))


def check_mixing(spark, df, given):
    sizes = pairs(mixing.mix_sizes(spark, df, block=64, shard=256), "doc_id", "size", "source")
    assert sizes == sorted(((i, len((t or "").split()), s) for i, t, _, s, _ in given), key=key)
    taken, mixed = Counter(), Counter()
    for r in mixing.mix_sizes(spark, df, block=64, shard=256).collect():
        taken[r.doc_id] += r.taken
    found = mixing.mixed_documents(spark, df, block=64, shard=256)
    assert found.columns == df.columns
    for r in found.collect():
        mixed[r.doc_id] += len(r.text.split())
        assert r["a.b"] == r["_key"] == "c"
    assert +mixed == +taken


def check_lm(spark, df, given):
    found = lm.score(spark, df)
    assert pairs(found, "doc_id", "n_tokens") == sorted(((i, len((t or "").split()) + 1) for i, t, *_ in given), key=key)
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in found.collect())


def check_sharding(spark, df, given):
    found = sharding.kd_shards(spark, df, shards=4).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len((t or "").encode()) + 16) for i, t, *_ in given)
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(0 <= s < 4 and sorted(v) == list(range(len(v))) for s, v in slots.items())


def check_quality(spark, df, given):
    found = quality.compression_bands(df)
    assert pairs(found, "doc_id", "n_words") == sorted(((i, len((t or "").split())) for i, t, *_ in given), key=key)
    assert quality.compression_bands(df, only_kept=True).columns == df.columns
    assert quality.compression_bands(df, only_kept=True).count() == found.where("kept").count()


def check_shingles(spark, df, given):
    found = shingles.near_duplicates(spark, df)
    assert Counter(r.doc_id for r in found.collect()) == Counter(i for i, *_ in given)


def check_ann(spark, df, given):
    vectors = {t: [float(n % 5 + 1), float(n % 3), 1.0] for n, t in enumerate(dict.fromkeys(t for _, t, *_ in given))}
    of = F.udf(lambda t: None if t is None else vectors[t], "array<float>")
    df = df.withColumnRenamed("doc_id", "vec_id").withColumn("embedding", of("text"))
    found = ann.nearest(spark, df, every=5)
    assert found.schema["query_id"].dataType == df.schema["vec_id"].dataType
    whole = {i for i, t, *_ in given if t is not None and isinstance(i, int) and i % 5 == 0}
    assert {r.query_id for r in found.collect()} == whole


CHECKS = [check_warc, check_simhash, check_lines, check_packing, check_ann, check_mixing, check_lm, check_files, check_sharding, check_quality, check_shingles]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("check", CHECKS, ids=lambda f: f.__name__)
def test_awkward_rows(spark, check, kind):
    check(spark, table(spark, kind), rows(kind))
    if kind == "long":
        check(spark, table(spark, kind, empty=True), [])


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, empty):
    """Each stage on all rows that the one before keeps, and without rows."""
    docs = table(spark, "long", empty)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        assert set(corpus_pipeline.COLUMNS) <= set(found.columns) or name == "pack_sequences"
        count = found.count()
        assert not empty or count == 0
        if name == "quality_rules" and not empty:
            assert {r.doc_id for r in found.collect()} - {4} == {5, 6, 7, None}  # the others have under ten words
            docs = docs.select(*corpus_pipeline.COLUMNS)  # what follows is tried on all rows
        elif name in ("line_dedup", "near_duplicates", "mix_sources"):
            docs = found
        if name == "near_duplicates" and not empty:
            assert Counter(r.doc_id for r in found.collect())[10] == 3 and 9 not in {r.doc_id for r in found.collect()}


def test_warc_bytes_are_the_rows_alone(spark, tmp_path):
    """60,000 pages, far more than any sample, written twice in other partitions: the same files with the same bytes."""
    pages = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x" * 500), (F.col("id") % 50_000).cast("string"), F.lit("y" * 600)).alias("html"))
    found = []
    for n, parts in enumerate((3, 8)):
        (tmp_path / str(n)).mkdir()
        warc.write_warc(spark, pages.repartition(parts), (tmp_path / str(n)).as_uri(), roll_bytes=1 << 20)
        found.append({p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / str(n)).iterdir()})
    assert found[0] == found[1] and len({n[:11] for n in found[0] if n.endswith(".warc.gz")}) > 3


def test_token_files_are_the_rows_alone(spark, tmp_path, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a text of words"), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(common, "LEAST_RANGE", 1 << 14)
    monkeypatch.setattr(common.cut_points, "__defaults__", (1 << 14, 1 << 20))
    found = []
    for n, parts in enumerate((2, 5)):
        (tmp_path / str(n)).mkdir()
        tokenfiles.write_token_files(spark, docs.repartition(parts), (tmp_path / str(n)).as_uri())
        found.append({p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / str(n)).iterdir()})
    assert found[0] == found[1] and len(found[0]) > 6


def test_cut_points_follow_bytes(spark):
    keys = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("key"), F.xxhash64("id").alias("tie"), F.lit(1000).cast("long").alias("bytes"))
    points = common.cut_points(keys, least=1 << 20, most=1 << 20)
    dealt = common.deal(keys.repartition(7), points, "bigint").withColumn("p", F.spark_partition_id())
    counts = [r["count"] for r in dealt.groupBy("p").count().collect()]
    assert len(points) + 1 == len(counts) == 20 and max(counts) < 1.3 * 1000  # a third of the rows share the null key: cut by ties
    order = [tuple(r) for r in dealt.groupBy("p").agg(F.min(F.struct("key", "tie")).alias("a"), F.max(F.struct("key", "tie")).alias("b")).orderBy("p").select("a.key", "b.key").collect()]
    assert all((x[1] is None or y[0] is not None) and (x[1] is None or x[1] <= y[0]) for x, y in zip(order, order[1:]))


def test_crowded_trie(spark):
    """Fingerprints that crowd under one prefix are dealt on, and no link is lost: texts of one long stem differ in an end."""
    stem = " ".join(f"s{i}" for i in range(60))
    texts = [f"{stem} e{i} f{i % 7}" for i in range(300)] + [f"other {i} text {i * i} of its own {i % 5}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for errors in (0, 3):
        plain = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark, df, errors=errors, node_size=8).collect())
        fps = simhash.fingerprints([t.encode() for t in texts])
        up = list(range(len(texts)))
        for i in range(len(texts)):
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= errors):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
        assert [c for _, c in plain] == up


def test_groups_in_blocks(spark, monkeypatch):
    """A group of near copies over the size of a block is compared block by block."""
    stem = [f"s{i}" for i in range(120)]
    texts = [" ".join([*stem[: i % 9], f"x{i}", *stem[i % 9 + 1 :]]) for i in range(90)] + ["alone " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = pairs(shingles.near_duplicates(spark, df), "doc_id", "component_id")
    monkeypatch.setattr(shingles, "GROUP_BYTES", 6000)
    assert pairs(shingles.near_duplicates(spark, df), "doc_id", "component_id") == plain and len({c for _, c in plain}) < 10


def test_other_vocabularies_are_encoded_whole(spark):
    """A vocabulary that keeps white space gives the library's ids too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a  b\n c", "", None, "it's  here "]
    assert not tokens.drops_white_space(path) and tokens.drops_white_space(tokens.default_vocabulary())
    ids, edges = tokens.encoder(path).encode(pa.array(texts), 2)
    plain = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_files_off_a_mounted_folder(tmp_path, monkeypatch):
    """Where the store is no local folder, slices are read as they are asked for."""
    (tmp_path / "f").write_bytes(np.arange(1000, dtype="<u2").tobytes())
    monkeypatch.setattr(tokenfiles.pafs, "LocalFileSystem", type(None))
    array = tokenfiles.FileArray((tmp_path / "f").as_uri(), "<u2")
    assert array.whole is None and array[5:9].tolist() == [5, 6, 7, 8] and array[999:1000].tolist() == [999]


CONTRACT = {
    "op1": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2": "doc_id bigint, fingerprint string, component_id bigint",
    "op3": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op4": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op5": "query_id bigint, rank int, vec_id bigint, score double",
    "op6": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_what_is_asked(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    wanted = CONTRACT[name.split("_")[0]].split(", ")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in found.schema][: len(wanted)] == wanted
    assert found.count() >= {"op1": 50, "op5": 50}.get(name.split("_")[0], 200)
