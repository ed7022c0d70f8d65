"""Sources, boundaries, streaming, settings and commands."""

import json

import pytest
from pyspark.sql import functions as F

from pagelode import __main__ as cli
from pagelode.config import DEFAULT, merged_options, preset
from pagelode.plans import flows
from pagelode.sources import boundary, markdown, sidecar
from pagelode.streaming import ingest

PAGE = {"page": 1, "markdown": "# A", "blocks": [{"type": "text", "content": "hello", "citation": "c1", "bbox": [0, 0, 1, 1]}, {"type": "table", "markdown": "|a|", "citation": "c2"}, {"type": "graphics"}], "citations": {"c1": {"page": 1, "source": "text"}}}


def test_sidecar_layouts(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"pdf_name": "one", "pages": [PAGE]}))
    (tmp_path / "two.json").write_text(json.dumps([PAGE]))
    (tmp_path / "bad.json").write_text("{}")
    pages = sidecar.read_sidecars(spark, str(tmp_path))
    blocks = sidecar.blocks(pages)
    rows = [(r.doc_id, r.ord, r.type, r.content, r.markdown_table, r.md_end, r.source) for r in blocks.orderBy("doc_id", "ord").collect()]
    assert rows[:3] == [("one", 1, "text", "hello", None, 5, "text"), ("one", 2, "table", None, "|a|", None, None), ("one", 3, "graphics", None, None, None, None)]
    assert len(rows) == 6 and sidecar.blocks(pages, keep_graphics=False).count() == 4
    assert [r.file.rsplit("/", 1)[1] for r in sidecar.unreadable(spark, str(tmp_path)).collect()] == ["bad.json"]
    text = sidecar.to_sidecars(sidecar.pages(pages), blocks).where("doc_id = 'one'").first()["value"]
    assert json.loads(text)["pages"][0]["blocks"][0]["content"] == "hello"


def test_markdown_notes(spark):
    pages = spark.createDataFrame([("d", 1, "see ![x](img/a.png) and ![y](b.png)")], "doc_id string, page int, markdown string")
    blocks = spark.createDataFrame([("d", 1, "picture", "c1", "out/a.png")], "doc_id string, page int, type string, citation string, image_ref string")
    ocr = spark.createDataFrame([("d", 1, "c1", "o1", "words")], "doc_id string, page int, associated_block string, citation string, text string")
    text = markdown.with_ocr_notes(pages, blocks, ocr).first()["markdown"]
    assert text.startswith("see ![x](img/a.png) [^o1] and ![y](b.png)\n\n## Citations") and text.endswith("[^o1]: words")
    master = markdown.master_document(markdown.with_ocr_notes(pages, blocks, ocr), ocr, F.lit("T")).first()["markdown"]
    assert master.startswith("# T") and master.count("[^o1]") == 2


def test_page_errors_are_rows(spark, tmp_path):
    class Failing(boundary.TextDecoder):
        def decode(self, content, page):
            if page == 2:
                raise ValueError("torn page")
            return super().decode(content, page)

    (tmp_path / "a.txt").write_bytes(b"first\fsecond\fthird")
    rows = boundary.extract_pages(boundary.read_files(spark, str(tmp_path)), Failing()).orderBy("page").collect()
    assert [(r.page, r.markdown, r.error) for r in rows] == [(1, "first", None), (2, None, "torn page"), (3, "third", None)]
    with pytest.raises(ImportError):
        boundary.pdf_decoder()


def test_generate(spark):
    class Counting(boundary.StubProvider):
        def generate(self, prompt, system_prompt=None):
            if "fail" in prompt:
                raise RuntimeError("no answer")
            return "new"

    cache = spark.createDataFrame([(boundary.hashlib.sha256(b"stub::p1").hexdigest(), "old", "fixed", True), (boundary.hashlib.sha256(b"stub::p2").hexdigest(), "old", None, False)], "prompt_hash string, original_response string, corrected_response string, is_verified boolean")
    prompts = spark.createDataFrame([("p1",), ("p2",), ("p2",), ("fail",)], "prompt_text string")
    found = sorted((r.prompt_text, r.response, r.cached, r.error) for r in boundary.generate(prompts, cache, Counting()).na.fill("").collect())
    assert found == [("fail", "", False, "no answer"), ("p1", "fixed", True, ""), ("p2", "new", False, ""), ("p2", "new", False, "")]
    with pytest.raises(ValueError):
        boundary.provider("odd")


def test_discovery(spark):
    chunks = spark.createDataFrame([(i, f"message structure {i} of the supported protocol") for i in range(30)] + [(99, "other words")], "doc long, text string")
    cache = spark.createDataFrame([], "prompt_hash string, original_response string, corrected_response string, is_verified boolean")
    rows = flows.discover(spark, chunks, cache, boundary.StubProvider(), "dev").collect()
    assert len(rows) == 1 and rows[0].data["message_id"].startswith("M") and 0 <= rows[0].confidence <= 1


def test_rate_limiter():
    now, slept = [0.0], []
    limiter = boundary.RateLimiter(2, 1, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        limiter.acquire()
    assert slept == [0.5, 0.5]


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert boundary.with_retries(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3


def test_embed(spark):
    df = spark.createDataFrame([("the cat",), ("the cat",), (" ",), (None,)], "t string").select(boundary.embed(F.col("t"), boundary.hashing_embedder(16)).alias("v"))
    a, b, blank, null = (r.v for r in df.collect())
    assert a == b and sum(x * x for x in a) == pytest.approx(1, rel=1e-5) and not any(blank) and not any(null)


def test_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    for n in range(2):
        (inbox / f"{n}.json").write_text(json.dumps({"pdf_name": f"d{n}", "pages": [PAGE]}) + "\n")
        ingest.ingest(ingest.stream_sidecars(spark, str(inbox)), str(out), str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(str(out)).count() == 3 * (n + 1)  # each file once


def test_settings():
    assert preset(7).top_k == 3 and preset(13) is DEFAULT and preset(70).chunk_size == 1024
    with pytest.raises(ValueError):
        DEFAULT.merge(odd=1)
    assert merged_options({"a": 1, "output_dir": "f"}, {"a": 2, "b": None, "output_dir": "c"}) == {"a": 2, "output_dir": "f"}


def test_commands(spark, tmp_path, capsys):
    spec, store = tmp_path / "spec.txt", str(tmp_path / "store")
    spec.write_text("Message OBS.R01 sent device to host\n\nand XYZ.R99 too")
    base = ["--store", store, "--vendor", "V", "--model", "M", "--file", str(spec)]
    cli.main(["onboard", *base, "--version", "1"])
    assert "**Total Messages:** 2" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["onboard", *base, "--version", "1"])
    cli.main(["update", *base, "--version", "2"])
    assert "No Changes Detected" in capsys.readouterr().out
    spec.write_text("Message OBS.R01 sent device to host\n\nand QCN.R01 too")
    assert cli.main(["update", *base, "--version", "3"]) == 1  # changes of HIGH impact wait for a reason
    said = capsys.readouterr().out
    assert "**Required:** YES" in said and "nothing is registered" in said
    cli.main(["list", "--store", store])
    assert "V_M 2" in capsys.readouterr().out
    assert cli.main(["update", *base, "--version", "3", "--approve", "agreed"]) == 0
    assert "Approved: agreed" in capsys.readouterr().out
    cli.main(["review-message", "--store", store, "--device-type", "V_M", "--message", "XYZ.R99", "--action", "approve"])
    cli.main(["list", "--store", store])
    assert "V_M 3" in capsys.readouterr().out


class Rect(tuple):
    def __new__(cls, *xs):
        return super().__new__(cls, xs)

    x0, y0, x1, y1 = (property(lambda self, i=i: self[i]) for i in range(4))


def fake_pdf(pages):
    """A stand-in for the PDF library: pages are texts."""
    import types

    class Pixels:
        n, alpha = 4, 0

        def __init__(self, *args):
            self.args = args

        def tobytes(self, kind):
            return f"{kind}{len(self.args)}".encode()

    class Page:
        rect = Rect(0, 0, 600, 800)
        drawn = 0

        def __init__(self, text, parent):
            self.text, self.parent = text, parent

        def get_text(self, kind):
            if "torn" in self.text:
                raise ValueError("torn page")
            return {"blocks": [{"type": 0, "bbox": (1, 2, 3, 4), "lines": [{"spans": [{"text": w} for w in self.text.split()]}]}, {"type": 1}]}

        def get_images(self, full):
            return [(7,), (8,)]

        def get_image_rects(self, xref):
            return [(0, 0, 10, 10)] if xref == 7 else []

        def find_tables(self, strategy=None):
            if strategy is None:
                raise ValueError("no lines")
            return types.SimpleNamespace(tables=[types.SimpleNamespace(bbox=(0, 0, 9, 9), to_markdown=lambda: "|a|")])

        def get_drawings(self):
            return [{"rect": (0, 0, 30, 30)}, {"rect": (0, 0, 30, 5)}]

        def draw_rect(self, box, color, width):
            self.drawn += 1

        def get_pixmap(self, clip=None, dpi=0):
            return types.SimpleNamespace(tobytes=lambda kind: f"{kind} {clip} {self.drawn}".encode())

    class Doc(list):
        page_count = property(len)

        def __enter__(self):
            return self

        def __exit__(self, *args):
            pass

    def open_(stream, filetype):
        doc = Doc()
        doc.extend(Page(t, doc) for t in stream.decode().split("\f"))
        return doc

    return types.SimpleNamespace(open=open_, Rect=Rect, Pixmap=Pixels, csRGB="rgb")


def test_pdf_decoder(monkeypatch):
    import sys

    from pagelode.sources.pdf import PdfDecoder

    monkeypatch.setitem(sys.modules, "pymupdf", fake_pdf(1))
    decoder, content = PdfDecoder("spec"), b"two words\ftorn"
    assert decoder.page_count(content) == 2
    markdown, blocks = decoder.decode(content, 1)
    kinds = [(b["type"], b.get("content") or b.get("image_ref") or b.get("markdown_table")) for b in json.loads(blocks)]
    assert kinds == [("text", "two words"), ("picture", "spec_p1_img1.png"), ("table", "|a|"), ("graphics", None)] and markdown.startswith("two words\n\n![1](spec_p1_img1.png)")
    with pytest.raises(ValueError, match="torn"):
        decoder.decode(content, 2)
    assert decoder.images(content, 1) == [("spec_p1_img1.png", b"png2")]  # four colours became three
    assert decoder.crop(content, 1, [5, 5, 595, 100]) == b"png (0, 0, 600, 110.0) 0" and decoder.overlay(content, 1, [("text", [0, 0, 1, 1]), ("table", [0, 0, 1, 1])]) == b"png None 2"


def test_pictures_are_rows(spark, tmp_path):
    from pagelode.sources import pdf

    class Decoder:
        def crop(self, content, page, box, padding):
            if page == 2:
                raise ValueError("torn page")
            return bytes(content) + str([page, box, padding]).encode()

        def overlay(self, content, page, boxes):
            return str(sorted(boxes)).encode()

    blocks = spark.createDataFrame([("d", 1, "text", "c1", (0.0, 1.0, 2.0, 3.0), b"x"), ("d", 2, "table", "c2", (0.0, 0.0, 1.0, 1.0), b"x")], "doc_id string, page int, type string, citation string, bbox struct<x0: double, y0: double, x1: double, y1: double>, content binary")
    crops = pdf.block_crops(blocks, Decoder(), 4.0)
    assert sorted((r.name or "", bytes(r.content or b""), r.error) for r in crops.collect()) == [("", b"", "torn page"), ("c1.png", b"x[1, [0.0, 1.0, 2.0, 3.0], 4.0]", None)]
    assert [r.name for r in pdf.save_pictures(crops, tmp_path.as_uri()).collect()] == ["c1.png"] and (tmp_path / "c1.png").exists()
    shown = pdf.page_overlays(blocks, blocks.select("doc_id", "content").distinct(), Decoder())
    assert sorted(r.name for r in shown.collect()) == ["d_p1_overlay.png", "d_p2_overlay.png"]


def test_providers():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from pagelode.sources import providers

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization") or self.headers.get("x-api-key")))
            code = 503 if "busy" in str(body) else 400 if "bad" in str(body) else 200
            answer = {"/api/generate": {"response": "one"}, "/chat/completions": {"choices": [{"message": {"content": "two"}}]}, "/messages": {"content": [{"type": "text", "text": "three"}]}}[self.path]
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        answers = [boundary.provider(name, model="m", base_url=url, key="k").generate("ask", "be brief") for name in ("ollama", "chat", "messages")]
        assert answers == ["one", "two", "three"] and [k for _, _, k in seen] == [None, "Bearer k", "k"]
        assert seen[0][1]["system"] == seen[2][1]["system"] == "be brief" and seen[1][1]["messages"][0] == {"role": "system", "content": "be brief"}
        with pytest.raises(ConnectionError):
            providers.ChatProvider("m", url).generate("busy")
        with pytest.raises(ValueError, match="400"):
            providers.ChatProvider("m", url).generate("bad")
        assert "key" not in repr(providers.ChatProvider("m", url, "secret"))
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(ConnectionError):
        boundary.provider("chat", model="m", base_url=url)


def test_stores(spark, tmp_path):
    from pagelode.sources import stores

    store = stores.Tables(spark, str(tmp_path))
    assert store.table("none", "a int").collect() == []
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "part-0.parquet").write_bytes(b"no table")
    assert store.table("torn", "a int").collect() == []
    first = store.put("t", spark.createDataFrame([(1,), (2,)], "a int"))
    assert sorted(r.a for r in store.put("t", first.where("a > 1")).collect()) == [2] and not list(tmp_path.glob("t.new-*"))
    at = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp")
    chunks = spark.createDataFrame([("p", "j", "x"), ("p", "j", "y")], "pdf_name string, json_path string, chunk string")
    stores.indexed(store, chunks, at(1))
    stores.indexed(store, chunks.limit(1), at(2))
    assert [(r.pdf_name, r.chunk_count) for r in stores.manifest(store).collect()] == [("p", 1)]
    report = spark.createDataFrame([("d", 0.9)], "doc_id string, compliance_score double")
    keys = {stores.save_compliance(store, report, at(1)) for _ in range(2)}
    held = store.table("compliance", "doc_id string, compliance_score double, report_id string, reported_at timestamp").collect()
    assert {r.report_id for r in held} == {f"compliance_20240101_000000_{k}" for k in keys} and len(keys) == 2
    index = stores.VectorIndex(spark, str(tmp_path / "v")).add_texts(spark.createDataFrame([(1, "the cat"), (2, "a dog")], "id long, text string"))
    asked = spark.createDataFrame([(0, "cat the")], "query_id int, t string").select("query_id", boundary.embed(F.col("t")).alias("query"))
    assert [(r.id, r.text) for r in index.search(asked, 1).collect()] == [(1, "the cat")]


def test_blueprint_command(spark, tmp_path, capsys, monkeypatch):
    class Model:
        model = "canned"

        def generate(self, prompt, system_prompt=None):
            if prompt.startswith("List as JSON"):
                return 'Here: ```json\n[{"message_type": "OBS.R01", "direction": "out", "description": "results"}, {"message_type": "ZXA.R02", "direction": "in", "description": "own"}]\n```'
            return '[{"field_name": "a", "data_type": "ST", "cardinality": "1", "description": "x"}, {"field_name": "b"}]' if "OBS.R01" in prompt else "no list"

    monkeypatch.setitem(boundary.PROVIDERS, "canned", Model)
    spec, store, out = tmp_path / "spec.txt", str(tmp_path / "store"), tmp_path / "blueprint.json"
    spec.write_text("Message OBS.R01 structure with field definitions, sent device to host\n\nVendor message ZXA.R02 structure")
    cli.main(["onboard", "--store", store, "--vendor", "V", "--model", "M", "--file", str(spec), "--version", "1"])
    cli.main(["extract-blueprint", "--store", store, "--device-id", "V_M", "--device-name", "Device", "--provider", "canned", "--output", str(out)])
    assert "[discovery]" in capsys.readouterr().out
    found = json.loads(out.read_text())
    messages = {m["message_type"]: m for m in found["messages"]}
    assert [f["field_name"] for f in messages["OBS.R01"]["fields"]] == ["a", "b"] and messages["OBS.R01"]["field_confidence"] == pytest.approx(0.5 * 0.75 + 0.2 * 0.625)  # keyword search finds nothing in two chunks
    assert messages["ZXA.R02"]["fields"] == [] and messages["ZXA.R02"]["error"] == "the answer is no JSON list" and messages["ZXA.R02"]["field_confidence"] == 0
    assert found["summary"] == {"total_messages": 2, "core_messages": 1, "vendor_messages": 1, "field_count": 2}


def test_whole_sidecars(spark, tmp_path):
    """Citations, OCR results and metadata survive the writer and the reader."""
    page = PAGE | {"ocr": [{"bbox": [0, 0, 2, 2], "text": "seen", "confidence": 0.8, "citation": "o1", "associated_block": "c1"}], "metadata": {"k": "v"}, "citations": {"c1": {"page": 1, "bbox": [0, 0, 1, 1], "source": "text", "confidence": 0.7, "content_type": "text"}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps({"pages": [page]}))
    read = sidecar.read_sidecars(spark, str(tmp_path / "in"))
    rows = [f(read) for f in (sidecar.pages, sidecar.blocks, sidecar.citations, sidecar.ocr)]
    sidecar.write_sidecars(sidecar.to_sidecars(*rows), str(tmp_path / "out"))
    again = sidecar.read_sidecars(spark, str(tmp_path / "out"))
    for f, before in zip((sidecar.pages, sidecar.blocks, sidecar.citations, sidecar.ocr), rows, strict=True):
        assert [str(r) for r in f(again).collect()] == [str(r) for r in before.collect()] and before.count()


def test_positions_in_linear_time(spark):
    """A page with 100,000 matches ends in seconds, with every place right."""
    import time

    from pagelode.functions import text as T

    page = "".join(f"x{'y' * (i % 7)}ab" for i in range(100_000))
    began = time.perf_counter()
    spans = spark.createDataFrame([(page,), ("none",), (None,)], "t string").select(T.match_spans(F.coalesce("t", F.lit("")), "ab").alias("s")).collect()
    took = time.perf_counter() - began
    starts = [m["start"] for m in spans[0].s]
    want, at = [], -1
    while (at := page.find("ab", at + 1)) >= 0:
        want.append(at)
    assert starts == want and spans[1].s == spans[2].s == [] and took < 60


def test_chunks_that_would_stand_still(spark):
    from pagelode.operators import navigator

    with pytest.raises(ValueError):
        navigator.chunk_text(F.col("t"), 80, 40)


def test_reading_order_of_boxes_that_share_an_ord(spark, tmp_path):
    """Each box meets every order of its ord, as in the SQL of the query."""
    from pagelode.plans import more

    rows = [(1, n, p, 5, 0, "N", "O") for n, p in ((1, 200), (1, 200), (2, 300))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity int, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = sorted(more.cited_in_reading_order(spark, str(tmp_path)).collect())
    assert [(r.was, r.ord, r.citation) for r in found] == [(110020005, n, f"p0_txt{n}") for n in (1, 2, 3, 4)] + [(120030005, 5, "p0_txt5")]


def test_sidecars_of_large_documents(spark, tmp_path, monkeypatch):
    """A document beyond a file's characters is several files of whole pages; nothing is lost and small documents stay one."""
    page = lambda n: {"page": n, "markdown": f"# {n}", "blocks": [{"type": "text", "content": f"text {n} {i}", "citation": f"c{i}"} for i in range(3)], "citations": {f"c{i}": {"page": n, "source": f"s{i}"} for i in range(3)}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "large.json").write_text(json.dumps({"pages": [page(n) for n in (3, 1, 2, 5, 4)]}))
    (tmp_path / "in" / "small.json").write_text(json.dumps({"pages": [page(7)]}))
    read = sidecar.read_sidecars(spark, str(tmp_path / "in"))
    rows = [f(read) for f in (sidecar.pages, sidecar.blocks, sidecar.citations)]
    monkeypatch.setattr(sidecar, "PIECE", 3000)
    sidecar.write_sidecars(sidecar.to_sidecars(*rows), str(tmp_path / "out"))
    files = {d: [json.loads(f.read_text()) for f in (tmp_path / "out" / f"doc_id={d}").glob("part-*")] for d in ("large", "small")}
    assert sorted([p["page"] for p in f["pages"]] for f in files["large"]) == [[1, 2, 3], [4, 5]] and len(files["small"]) == 1
    assert {f["total_pages"] for f in files["large"]} == {5}
    again = sidecar.read_sidecars(spark, str(tmp_path / "out"))
    for f, before in zip((sidecar.pages, sidecar.blocks, sidecar.citations), rows, strict=True):
        assert sorted(map(str, f(again).collect())) == sorted(map(str, before.collect())) and before.count()
    assert sorted({(r.citation, r.source) for r in sidecar.blocks(again).collect()}) == [("c0", "s0"), ("c1", "s1"), ("c2", "s2")]


def test_type_errors_parse_once(spark):
    rows = spark.createDataFrame([('{"a": 7, "b": true}',), ('{"a": "x", "b": null}',), ('{"b": 1.5}',), ("torn",), (None,)], "data string")
    found = rows.select(flows.type_errors(F.col("data"), {"a": "string", "b": "number"}).alias("e"))
    assert found._jdf.queryExecution().analyzed().toString().count("from_json") == 1
    assert [r.e or [] for r in found.collect()] == [["Field 'a': expected string, got int", "Field 'b': expected number, got bool"], ["Field 'b': expected number, got NoneType"], [], [], []]
