"""PDF files through the pymupdf library, where it is installed: pages, blocks, images, crops and overlays."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The colours in which an overlay draws each kind of block.
COLOURS = {"text": (0, 0, 1), "picture": (0, 0.6, 0), "table": (1, 0, 0), "graphics": (1, 0.5, 0)}
LEAST_DRAWING, PADDING, DPI = 20.0, 10.0, 150


class PdfDecoder:
    """A ``PageDecoder`` over pymupdf.  The library is imported where it is used, so the decoder itself can be sent anywhere.

    A page whose tables cannot be read is read without them, and one whose text cannot
    be laid out has blocks and an empty markdown.
    """

    def __init__(self, name: str = "doc") -> None:
        self.name = name

    def _open(self, content: bytes):
        return importlib.import_module("pymupdf").open(stream=content, filetype="pdf")

    def page_count(self, content: bytes) -> int:
        with self._open(content) as doc:
            return doc.page_count

    def decode(self, content: bytes, page: int) -> tuple[str, str]:
        with self._open(content) as doc:
            leaf = doc[page - 1]
            blocks, parts, at = [], [], 0
            for b in leaf.get_text("dict")["blocks"]:
                if b["type"] == 0:
                    text = " ".join(s["text"] for line in b["lines"] for s in line["spans"]).strip()
                    if text:
                        blocks.append({"type": "text", "content": text, "md_slice": [at, at + len(text)], "bbox": [float(x) for x in b["bbox"]]})
                        parts.append(text)
                        at += len(text) + 2
            for n, (name, box, _) in enumerate(self._images(leaf, page, pixels=False), 1):
                blocks.append({"type": "picture", "image_ref": name, "bbox": box})
                parts.append(f"![{n}]({name})")
            for n, (box, markdown) in enumerate(self._tables(leaf), 1):
                blocks.append({"type": "table", "table_ref": f"table_{page}_{n}", "markdown_table": markdown, "bbox": box})
                parts.append(markdown)
            for d in leaf.get_drawings():
                box = [float(x) for x in d["rect"]]
                if box[2] - box[0] >= LEAST_DRAWING and box[3] - box[1] >= LEAST_DRAWING:
                    blocks.append({"type": "graphics", "bbox": box})
            return "\n\n".join(parts), json.dumps(blocks)

    @staticmethod
    def _tables(leaf) -> list[tuple[list[float], str]]:
        for options in ({}, {"strategy": "text"}):
            try:
                return [([float(x) for x in t.bbox], t.to_markdown()) for t in leaf.find_tables(**options).tables]
            except Exception:  # noqa: BLE001  a page with unreadable tables is read without them
                continue
        return []

    def _images(self, leaf, page: int, pixels: bool = True) -> Iterator[tuple[str, list[float], bytes | None]]:
        """Name, box and PNG bytes of each image that stands on the page."""
        for n, image in enumerate(leaf.get_images(full=True), 1):
            places = leaf.get_image_rects(image[0])
            if places:
                yield f"{self.name}_p{page}_img{n}.png", [float(x) for x in places[0]], self._png(leaf, image[0]) if pixels else None

    @staticmethod
    def _png(leaf, xref: int) -> bytes:
        pymupdf = importlib.import_module("pymupdf")
        pixels = pymupdf.Pixmap(leaf.parent, xref)
        if pixels.n - pixels.alpha > 3:  # four colours become three
            pixels = pymupdf.Pixmap(pymupdf.csRGB, pixels)
        return pixels.tobytes("png")

    def images(self, content: bytes, page: int) -> list[tuple[str, bytes]]:
        with self._open(content) as doc:
            return [(name, png) for name, _, png in self._images(doc[page - 1], page)]

    def crop(self, content: bytes, page: int, box: list[float], padding: float = PADDING, dpi: int = DPI) -> bytes:
        """A picture of a box and some room around it, cut to the page."""
        pymupdf = importlib.import_module("pymupdf")
        with self._open(content) as doc:
            leaf = doc[page - 1]
            edge = leaf.rect
            clip = pymupdf.Rect(max(box[0] - padding, edge.x0), max(box[1] - padding, edge.y0), min(box[2] + padding, edge.x1), min(box[3] + padding, edge.y1))
            return leaf.get_pixmap(clip=clip, dpi=dpi).tobytes("png")

    def overlay(self, content: bytes, page: int, boxes: list[tuple[str, list[float]]], dpi: int = DPI) -> bytes:
        """A picture of the page with a coloured frame around each block (kind, box)."""
        with self._open(content) as doc:
            leaf = doc[page - 1]
            for kind, box in boxes:
                leaf.draw_rect(box, color=COLOURS.get(kind, (0.5, 0.5, 0.5)), width=1)
            return leaf.get_pixmap(dpi=dpi).tobytes("png")


def _pictures(rows: DataFrame, columns: list[str], make: Callable[..., list[tuple[str, bytes]]]) -> DataFrame:
    """name and content of the pictures that ``make`` gives for each row, or the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    found = [(name, png, None) for name, png in make(*row)]
                except Exception as e:  # noqa: BLE001  a picture that fails is a row
                    found = [(None, None, str(e))]
                if found:
                    yield pd.DataFrame(found, columns=["name", "content", "error"])

    return rows.select(*columns).mapInPandas(run, "name string, content binary, error string")


def page_images(pages: DataFrame, decoder: PdfDecoder) -> DataFrame:
    """The images of pages (content, page)."""
    return _pictures(pages, ["content", "page"], lambda content, page: decoder.images(content, page))


def block_crops(blocks: DataFrame, decoder: PdfDecoder, padding: float = PADDING) -> DataFrame:
    """A crop of each block (content, page, citation, bbox)."""
    rows = blocks.withColumn("box", F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"))
    return _pictures(rows, ["content", "page", "citation", "box"], lambda content, page, citation, box: [(f"{citation}.png", decoder.crop(content, page, [float(x) for x in box], padding))])


def page_overlays(blocks: DataFrame, files: DataFrame, decoder: PdfDecoder) -> DataFrame:
    """A picture of each page of the files (doc_id, content) with its blocks (doc_id, page, type, bbox) framed."""
    boxes = blocks.groupBy("doc_id", "page").agg(F.collect_list(F.struct("type", F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1").alias("box"))).alias("boxes"))
    rows = boxes.join(files.select("doc_id", "content"), "doc_id")
    return _pictures(rows, ["content", "doc_id", "page", "boxes"], lambda content, doc, page, boxes: [(f"{doc}_p{page}_overlay.png", decoder.overlay(content, page, [(b["type"], [float(x) for x in b["box"]]) for b in boxes]))])


def save_pictures(pictures: DataFrame, folder: str) -> DataFrame:
    """Write pictures (name, content) into a folder that all executors see; returns name and bytes of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with store.open_output_stream(f"{path}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"name": batch["name"], "bytes": [len(c) for c in batch["content"]]})

    return pictures.where(F.col("content").isNotNull()).select("name", "content").mapInPandas(run, "name string, bytes long")
