"""Operators on small documents, whatever the number of partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.functions import geometry as G
from pagelode.operators import blocks as B
from pagelode.operators import diff, fields, images, integrity, messages, navigator, registry, search
from pagelode.plans import flows

TEXT = "doc_id string, page int, ord int, type string, content string, markdown_table string, citation string"


def text_blocks(spark, *contents):
    return spark.createDataFrame([("d", i // 2 + 1, i, "text", c, None, f"c{i}") for i, c in enumerate(contents)], TEXT)


@pytest.mark.parametrize("parts", [1, 7])
def test_messages(spark, parts):
    df = text_blocks(spark, "OBS.R01 sent device to host", "OBS^OBS_R01 and QCN.R01 query", "ZABC and Mes.custom.v2", "XYZ_R99, bidirectional", "OBS.R01 again", None).repartition(parts)
    found = {r.message_id: (r.direction, r.category, r.citation) for r in messages.categorise(messages.extract_messages(df)).collect()}
    assert found["OBS.R01"] == ("→Host", "observation", "c0")
    assert found["QCN.R01"] == ("←Device", "config", "c1")
    assert found["ZAB"][1] == found["ZABC"][1] == found["Mes.custom.v2"][1] == "vendor_specific"
    assert found["XYZ.R99"] == ("↔Both", "unrecognized", "c3")


def test_field_specs(spark):
    table = "| Field | Name | Type |\n|---|---|---|\n| MSH-9 | Kind | ST |\n| MSH.10 |  | NM |"
    df = spark.createDataFrame([("d", 1, 1, "text", "see MSH-9 and OBX_5", None, "a"), ("d", 1, 2, "table", None, table, "b")], TEXT)
    found = {r.field_id: (r.name, r.data_type, r.citation) for r in messages.field_specs(df).collect()}
    assert found == {"MSH-9": (None, None, "a"), "OBX-5": (None, None, "a"), "MSH-10": (None, "NM", "b")}


def test_fields_and_schemas(spark):
    table = "| Field | Description | Example |\n|---|---|---|\n| HDR.a_cd | Code, one of: ON, OFF | ON |\n| HDR.b | When | 20240101000000 |\n| name | x | y |\n| short |"
    pages = spark.createDataFrame([("d", 1, "About OBS.R01 and QCN.R01"), ("d", 2, "none")], "doc_id string, page int, markdown string")
    df = spark.createDataFrame([("d", 1, 1, "table", None, table, "t1"), ("d", 2, 1, "table", None, table, "t2")], TEXT)
    found = fields.field_definitions(pages, df)
    assert [(r.field_name, r.field_type, r.message_id) for r in found.orderBy("row").collect()] == [("HDR.a_cd", "code", "OBS.R01"), ("HDR.b", "datetime", "OBS.R01")]
    schema = fields.message_schemas(found).first()
    assert (schema.trigger_event, schema.description, schema.citation, len(schema.fields)) == ("R01", "Observation Message - Patient Results", "t1", 2)
    assert [v["value"] for v in fields.enum_definitions(found).first()["values"]] == ["OFF", "ON"]


def test_fields_are_read_once_and_after_a_shuffled_join(spark):
    table = "| Field | Description | Example |\n|---|---|---|\n| HDR.a_cd | Code, one of: ON, OFF | ON |\n| HDR.b_cd | Code | - |\n| HDR.c | When | 20240101000000 |\n| short |"
    pages = spark.createDataFrame([("d", 1, "About OBS.R01"), ("d", 2, "none"), ("d", 3, None)], "doc_id string, page int, markdown string")
    df = spark.createDataFrame([("d", p, 1, "table", None, t, f"t{p}{i}") for p in (1, 2, 3) for i, t in enumerate((table, None, "| Field |\n|---|", "| Other |\n|---|\n| x |"))], TEXT)
    found = fields.enum_definitions(fields.field_definitions(pages, df))
    assert [(r.message_id, r.row, r.field_name, [v["value"] for v in r["values"]]) for r in found.collect()] == [("OBS.R01", 0, "HDR.a_cd", ["OFF", "ON"])]
    plan = found._jdf.queryExecution()
    assert "Broadcast" not in plan.sparkPlan().toString()
    optimized = plan.optimizedPlan().toString()
    assert (optimized.count(r", \|, -1)"), optimized.count("Either") + optimized.count("[Ee]ither")) == (2, 2)  # header and line; two groups of one pattern


def test_analyte_tables(spark):
    table = "| Analyte | Test type |\n|---|---|\n| Sodium | - |\n| Glucose | strip |"
    df = spark.createDataFrame([("d", 1, 1, "table", None, table, "t")], TEXT)
    assert sorted((r.name, r.test_type) for r in fields.table_analytes(df).collect()) == [("Glucose", "strip"), ("Sodium", None)]
    both = fields.table_analytes(df).unionByName(fields.text_analytes(text_blocks(spark, "analytes: glucose, Iron")))
    assert sorted((r.name, r.source) for r in fields.unique_analytes(both).collect()) == [("Glucose", "table"), ("Iron", "text_mention"), ("Sodium", "table")]


def test_navigation(spark):
    pages = spark.createDataFrame([("d", 1, "# One\ntext the Thing\n## Two\nthe end"), ("d", 2, "### Three\nthe"), ("d", 3, None)], "doc_id string, page int, markdown string")
    spans = navigator.search_spans(pages, "the", top_k=3).orderBy("rank").collect()
    assert [(r.page, r.start, r.text, r.total_results) for r in spans] == [(1, 11, "the", 3), (1, 28, "the", 3), (2, 10, "the", 3)]
    toc = navigator.toc(navigator.headings(pages))
    assert [(r.text, r.level, r.position, r.parent) for r in toc.orderBy("n").collect()] == [("One", 1, 0, None), ("Two", 2, 21, 1), ("Three", 3, 0, 2)]
    assert [r.text for r in navigator.subtree(toc, "two").orderBy("n").collect()] == ["Two", "Three"]
    blocks = spark.createDataFrame([("d", 1, 0, 10, 1, "c1"), ("d", 1, 5, 40, 2, "c2")], "doc_id string, page int, md_start int, md_end int, ord int, citation string")
    wanted = spark.createDataFrame([("d", 1, 6, 10), ("d", 1, 2, 99), ("d", 9, 0, 1)], "doc_id string, page int, start int, end int")
    assert sorted((r.text, r.citation, r.error) for r in navigator.get_span(pages, blocks, wanted).na.fill("").collect()) == [("", "", "page not found"), ("", "c1", "span beyond the page"), ("text", "c1", "")]


def test_spans_are_grouped_without_the_text(spark):
    pages = spark.createDataFrame([("d", 1, "one text"), ("d", 2, None), ("e", 1, "two")], "doc_id string, page int, markdown string")
    blocks = spark.createDataFrame([("d", 1, 0, 9, 2, "c2"), ("d", 1, 2, 9, 1, "c1"), ("e", 1, 5, 9, 1, "c3")], "doc_id string, page int, md_start int, md_end int, ord int, citation string")
    wanted = spark.createDataFrame([("d", 1, 4, 8), ("d", 1, 4, 8), ("d", 1, 0, 3), ("d", 2, 0, 1), ("e", 1, 0, 3)], "doc_id string, page int, start int, end int")
    found = navigator.get_span(pages, blocks, wanted)
    rows = sorted(tuple(r) for r in found.na.fill("").collect())
    assert rows == [("d", 1, 0, 3, "one", "c2", ""), ("d", 1, 4, 8, "text", "c1", ""), ("d", 2, 0, 1, "", "", "page not found"), ("e", 1, 0, 3, "two", "", "")]
    assert navigator.get_span(pages.union(pages), blocks, wanted).count() == 2 * len(rows)  # a page held twice answers twice, as in the SQL
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan
    assert "Aggregate" in plan and not any("markdown" in line for line in plan.splitlines() if "Aggregate" in line)


def chunks(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            for mark in (". ", ".\n", "! ", "?\n"):
                i = text[at:end].rfind(mark)
                if i > size // 2:
                    end = at + i + 2
                    break
        if text[at:end].strip():
            out.append(text[at:end].strip())
        at = end - overlap
    return out


def test_neighbors_beyond_the_text(spark):
    texts = {"long": "ab" * 100, "ends": "ab" * 55, "near": "ab" * 40, "short": "ab", "empty": "", "null": None}
    pages = spark.createDataFrame([(d, 1, t) for d, t in texts.items()], "doc_id string, page int, markdown string")
    spans = pages.select("doc_id", "page", F.lit(100).alias("start"), F.lit(120).alias("end"))
    found = {r.doc_id: r for r in navigator.neighbors(spans, pages, 50).collect()}
    assert found.keys() == texts.keys()
    for d, text in texts.items():
        t, r = text or "", found[d]
        assert (r.window_start, r.window_end, r.before, r.after) == (min(50, len(t)), min(170, len(t)), t[50:100], t[120:170])
        assert r.error == ("span beyond the page" if len(t) < 120 else None)


def test_chunks(spark):
    random.seed(3)
    texts = ["", "short", *("".join(random.choice(["word ", "end. ", "so! ", "why?\n", "x"]) for _ in range(n)) for n in (20, 60, 200))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", navigator.chunk_text(F.col("t"), 80, 10).alias("c"))
    for r in df.collect():
        assert [c.strip() for c in r.c] == [c.strip() for c in chunks(texts[r.i], 80, 10)], r.i


def test_text_tables(spark):
    rows = [("A", 0, 0.0), ("B", 50, 4.0), ("1", 1, 20.0), ("2", 52, 21.0), ("3", 0, 40.0), ("4", 49, 40.0), ("prose", 300, 200.0)]
    spans = spark.createDataFrame([("d", 1, t, float(x), y, 10.0, 8.0) for t, x, y in rows], "doc_id string, page int, text string, x double, y double, width double, height double")
    found = B.text_tables(spans).collect()
    assert found[0].markdown.startswith("| A | B |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |")
    anchored = spark.createDataFrame([("d", 1, t, 0.0, y, 1.0, 1.0) for t, y in (("a", 0.0), ("b", 4.0), ("c", 8.0))], spans.schema)
    assert sorted((r.row, len(r.cells)) for r in B.span_rows(anchored).collect()) == [(0, 2), (1, 1)]  # by the row's first y


def test_layout(spark):
    rows = [(1, "text", 0, 10, 600, 30), (2, "text", 350, 200, 580, 250), (3, "text", 20, 300, 280, 350), (4, "text", 20, 200, 280, 250), (5, "text", 0, 750, 600, 780), (6, "picture", 30, 400, 200, 500)]
    df = spark.createDataFrame([("d", 1, o, t, *map(float, b)) for o, t, *b in rows], "doc_id string, page int, ord int, type string, x0 double, y0 double, x1 double, y1 double")
    df = df.withColumn("bbox", G.bbox(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).withColumn("page_width", F.lit(600.0))
    order = {r.ord: r.reading_order for r in B.reading_order(df).collect()}
    assert order[1] == 0 and order[5] == 9000 and order[4] < order[3] < order[6] < order[2]
    cited = [r.citation for r in B.cite(B.reading_order(df)).orderBy("ord").collect()]
    assert cited == ["p1_txt1", "p1_txt2", "p1_txt3", "p1_img4", "p1_txt5", "p1_txt6"]
    assert {r.ord: r.reading_order for r in B.reading_order(df, compat=True).collect()}[5] == 0


def test_search(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog ran far"), (3, "a bird"), (4, "a fish"), (5, ""), (6, None)], "doc_id long, text string")
    terms, lengths = search.postings(docs), search.lengths(docs)
    q = spark.createDataFrame([(1, "cat dog dog"), (2, "nothing"), (3, "")], "query_id int, text string")
    found = search.bm25(q, terms, lengths).orderBy("rank").collect()
    assert [(r.query_id, r.doc, r.rank) for r in found] == [(1, 2, 1), (1, 1, 2)]
    vectors = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(6)], "id long, embedding array<float>, odd int")
    asked = spark.createDataFrame([(1, [2.2, 0.0])], "query_id int, query array<float>")
    assert [r.id for r in search.vector_search(asked, vectors, 3).orderBy("rank").collect()] == [2, 3, 1]
    assert [r.id for r in search.vector_search(asked, vectors, 2, F.col("odd") == 1).orderBy("rank").collect()] == [3, 1]
    with pytest.raises(ValueError):
        search.vector_search(asked, vectors, most_queries=0)
    s = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3)], "query_id int, key string, rank int")
    k = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, key string, rank int")
    fused = search.fuse(s, k).orderBy("rank").collect()
    assert [(r.key, r.sources) for r in fused] == [("b", "semantic+keyword"), ("a", "semantic"), ("c", "keyword")]
    with pytest.raises(ValueError):
        search.hybrid_search(q, vectors, terms, lengths, docs, mode="odd")


@pytest.mark.parametrize("post_filter", [None, False, True])
def test_vector_search_in_blocks(spark, post_filter):
    """Every row whose id is divisible by 20 against all rows, in blocks of queries, as by brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    table = rows.toPandas().sort_values("id")
    ids, labels, points = table["id"].to_numpy(), table["label"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float)
    wanted = {}
    for q in np.flatnonzero(ids % 20 == 0):
        order = np.lexsort((ids, ((points - points[q]) ** 2).sum(axis=1)))
        if post_filter is not None:
            order = order[:25] if post_filter else order
            order = order[labels[order] < 3]
        wanted |= {(int(ids[q]), n): int(ids[at]) for n, at in enumerate(order[:5], 1)}
    found = search.vector_search(asked, rows, 5, None if post_filter is None else F.col("label") < 3, bool(post_filter), most_queries=7).collect()
    assert {(r.query_id, r["rank"]): r.id for r in found} == wanted and len(found) == len(wanted)


def test_index_merge(spark):
    schema = "doc_id string, chunk string"
    index, added = spark.createDataFrame([("a", "1"), ("b", "2")], schema), spark.createDataFrame([("b", "3")], schema)
    assert sorted(map(tuple, search.merge_index(index, added).collect())) == [("a", "1"), ("b", "3")]


def test_diff(spark):
    old, new = text_blocks(spark, "same", "OBS.R01 old", "gone", "gone"), text_blocks(spark, "same", "ZPX new", None)
    changes = diff.block_changes(old, new)
    assert sorted((r.side, r.level, r.change_type) for r in changes.collect()) == [("added", "MEDIUM", "VENDOR_EXTENSION_MODIFIED"), ("removed", "HIGH", "MESSAGE_REMOVED"), ("removed", "LOW", "BLOCK_REMOVED")]
    decision = diff.rebuild_decision(changes).first()
    assert decision.requires_rebuild and decision.reason == "1 HIGH impact changes, 1 MEDIUM impact changes"
    assert diff.compare(None, new, None, "x")[0] == "baseline"
    assert diff.compare(old, new, "AB", "ab") == ("no_change", None)
    assert flows.update(old, new, "a", "b", "1", "2", "dev", "now").needs_approval


def test_integrity(spark):
    df = spark.createDataFrame([("d", 1, 1, "text", "a", 0.9), ("d", 3, 1, None, None, 0.4)], "doc_id string, page int, bbox int, source string, citation string, confidence double")
    assert [r.page for r in integrity.missing_pages(df, 3).collect()] == [2]
    assert sorted(r.page for r in integrity.missing_pages(df, 3, first_page=0).collect()) == [0, 2]
    row = integrity.compliance(df, spark.createDataFrame([("d", "fatal")], "doc_id string, severity string")).first()
    assert row.compliance_score == pytest.approx(0.5 * 0.4 + 0.65 * 0.3 + 0.9 * 0.2) and not row.is_compliant and len(row.issues) == 4
    whole = integrity.completeness(df, 3).first()
    assert (whole.n_missing, whole.first_missing, whole.no_source, whole.complete) == (1, [2], 1, False)


def test_registry_and_cache(spark):
    t = "timestamp'2024-01-0{}'"
    versions = spark.sql(f"SELECT * FROM VALUES ('a', '1', {t.format(1)}), ('a', '2', {t.format(3)}), ('b', '1', {t.format(2)}) v(device_id, version, registered_at)")
    assert sorted((r.device_id, r.version) for r in registry.latest_versions(versions).collect()) == [("a", "2"), ("b", "1")]
    wanted = spark.createDataFrame([("a", "2"), ("a", "3"), ("c", "1")], "device_id string, version string")
    assert [tuple(r) for r in registry.new_versions(versions, wanted)[0].collect()] == [("a", "3")]
    with pytest.raises(ValueError, match="a 2"):
        flows.register(versions, wanted)
    puts = spark.sql(f"SELECT * FROM VALUES ('h', 'old', {t.format(1)}), ('h', 'new', {t.format(4)}), ('g', 'x', {t.format(1)}) v(prompt_hash, original_response, created_at)")
    checks = spark.sql(f"SELECT * FROM VALUES ('h', 'fixed', {t.format(2)}), ('g', 'y', {t.format(2)}) v(prompt_hash, corrected_response, reviewed_at)")
    hits = spark.sql(f"SELECT * FROM VALUES ('h', {t.format(2)}), ('h', {t.format(5)}) v(prompt_hash, at)")
    view = {r.prompt_hash: r for r in registry.cache_view(puts, checks, hits).collect()}
    assert (view["h"].original_response, view["h"].is_verified, view["h"].hit_count) == ("new", False, 1)  # put anew
    assert (view["g"].corrected_response, view["g"].is_verified) == ("y", True)


def test_otsu(spark):
    df = spark.createDataFrame([("i", v) for v in [10] * 5 + [20] * 3 + [200] * 6 + [210] * 2], "image string, value int")
    counts = images.histogram(df, ["image"])
    assert images.otsu_threshold(counts, ["image"]).first()["threshold"] == 20
    assert images.is_dark(counts, ["image"]).first()["dark"]


def test_image_clean_up(spark):
    """Against loops over pixels; the threshold against the one of the counts."""
    rng = np.random.default_rng(4)
    page = rng.integers(0, 90, (12, 15)).astype(np.uint8)
    page[3:9, 4:11] += 130
    at = lambda a, y, x: a[min(max(y, 0), a.shape[0] - 1)][min(max(x, 0), a.shape[1] - 1)]
    byte = lambda v: int(min(max(v, 0), 255))

    def plain(image):
        h, w = len(image), len(image[0])
        mean = int(sum(map(sum, image.tolist())) / (h * w) + 0.5)
        strong = np.array([[byte(mean + 1.5 * (int(v) - mean)) for v in row] for row in image])
        ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        smooth = lambda y, x: int(sum(at(strong, y + a, x + b) * (5 if (a, b) == (0, 0) else 1) for a, b in ring) / 13 + 0.5)
        sharp = np.array([[byte(smooth(y, x) + 2.0 * (strong[y][x] - smooth(y, x))) for x in range(w)] for y in range(h)])
        counts = images.histogram(spark.createDataFrame([("i", int(v)) for v in sharp.ravel()], "image string, value int"), ["image"])
        cut = images.otsu_threshold(counts, ["image"]).first()["threshold"]
        tones = (sharp > cut) * 255
        calm = np.array([[sorted(at(tones, y + a, x + b) for a, b in ring)[4] for x in range(w)] for y in range(h)])
        return 255 - calm if calm.mean() < 127 else calm

    wanted = {"dark": plain(page), "light": plain(255 - page)}
    rows = [("dark", 15, 12, page.tobytes()), ("light", 15, 12, (255 - page).tobytes()), ("colour", 15, 12, np.repeat(page[..., None], 3, -1).tobytes()), ("torn", 15, 12, b"abc"), ("none", 15, 12, None)]
    found = {r.image: r for r in images.clean_images(spark.createDataFrame(rows, "image string, width int, height int, pixels binary")).collect()}
    for name, image in wanted.items():
        assert np.array_equal(np.frombuffer(found[name].pixels, np.uint8).reshape(12, 15), image) and found[name].error is None
    assert found["colour"].pixels == found["dark"].pixels and bytes(found["torn"].pixels) == b"abc" and found["torn"].error and found["none"].error


def test_refine(spark):
    rows = spark.createDataFrame([(1, {"a": "x", "b": ""}, 0.4), (2, {"a": "x", "b": "y"}, 0.3), (3, {}, 0.9)], "id int, data map<string,string>, confidence double")
    again = lambda d: d.select("id", F.create_map(F.lit("a"), F.lit("other"), F.lit("b"), F.lit("new")).alias("data"))
    found = {r.id: (r.data, r.confidence) for r in flows.refine(rows, ("a", "b"), again, 2).collect()}
    assert found[1][0] == {"a": "x", "b": "new"} and found[1][1] == pytest.approx((1 + 0.2) / 1.5)
    assert found[2] == ({"a": "x", "b": "y"}, 0.3) and found[3] == ({}, 0.9)


def test_hybrid_search_scores_each_text_once(spark, monkeypatch):
    """Many queries of two texts: keyword search sees two, and each query has its text's ranking."""
    docs = spark.createDataFrame([(1, "cat"), (2, "dog cat"), (3, "bird"), (4, "fish"), (5, "ant")], "doc_id long, text string")
    keys = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("key"))
    queries = spark.createDataFrame([(i, ("cat", "bird", None)[i % 3], [float(i), 0.0]) for i in range(12)], "query_id int, text string, query array<float>")
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(1, 6)], "id long, embedding array<float>")
    seen, plain = [], search.bm25_texts
    monkeypatch.setattr(search, "bm25_texts", lambda asked, *rest: seen.append(asked.where("text IS NOT NULL").count()) or plain(asked, *rest))
    found = search.hybrid_search(queries, vectors, docs, None, keys, 5, "keyword").collect()
    assert seen == [2]
    assert sorted((r.query_id, r.id, r.key, r["rank"]) for r in found) == sorted((i, *row) for i in range(12) for row in (((1, "cat", 1), (2, "dog cat", 2)), ((3, "bird", 1),), ())[i % 3])


def test_vector_blocks_are_small(spark, monkeypatch):
    """What a task of the query holds of 64 dimensions is some tens of MB, and a task that takes one query at a time finds the same."""
    assert (search.QUERY_BLOCK + search.VECTOR_BLOCK) * 64 * 8 + 3 * 8 * search._DISTANCES < 40 << 20
    monkeypatch.setattr(search, "_DISTANCES", 64)
    test_vector_search_in_blocks(spark, None)
