"""Boundaries: what needs a library, a model or a service comes in as a function, run in batches on the executors.

PDF decoding, OCR, embeddings and language models are protocols here.  Each has a
deterministic stand-in or a clear error where its library is missing; a page or
prompt that fails becomes an error row, never a failed job.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
import math
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions.hashing import prompt_hash
from pagelode.sources.providers import ChatProvider, LocalProvider, MessagesProvider, OllamaProvider

PAGES = "doc_id string, page int, markdown string, blocks string, error string"


class PageDecoder(Protocol):
    """Turns a file's bytes and a page number into markdown and a JSON list of blocks."""

    def page_count(self, content: bytes) -> int: ...

    def decode(self, content: bytes, page: int) -> tuple[str, str]: ...


class TextDecoder:
    """Decodes plain text whose pages are set apart by form feeds; the stand-in for a PDF library."""

    def page_count(self, content: bytes) -> int:
        return content.count(b"\f") + 1

    def decode(self, content: bytes, page: int) -> tuple[str, str]:
        text = content.decode("utf-8", "replace").split("\f")[page - 1]
        blocks, at = [], 0
        for part in text.split("\n\n"):
            if part.strip():
                blocks.append({"type": "text", "content": part.strip(), "md_slice": [at, at + len(part)], "bbox": [0.0, float(at), 100.0, float(at + len(part))]})
            at += len(part) + 2
        return text, json.dumps(blocks)


def pdf_decoder(name: str = "doc") -> PageDecoder:
    """The decoder of PDF files, where its library is installed."""
    if importlib.util.find_spec("pymupdf") is None:
        raise ImportError("decoding PDF files needs pymupdf; pass a decoder of your own to extract_pages")
    from pagelode.sources.pdf import PdfDecoder

    return PdfDecoder(name)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows with their hash: path, doc_id, content, file_hash."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("doc_id"), "content", F.sha2("content", 256).alias("file_hash"))


def extract_pages(files: DataFrame, decoder: PageDecoder, max_pages: int | None = None) -> DataFrame:
    """Every page of every file: markdown and blocks, or the error that it gave.  Files are spread over tasks and decoded one page at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                rows = []
                try:
                    count = decoder.page_count(content)
                except Exception as e:  # noqa: BLE001  any fault of a file is its row
                    yield pd.DataFrame([(doc, None, None, None, str(e))], columns=["doc_id", "page", "markdown", "blocks", "error"])
                    continue
                for page in range(1, min(count, max_pages or count) + 1):
                    try:
                        rows.append((doc, page, *decoder.decode(content, page), None))
                    except Exception as e:  # noqa: BLE001
                        rows.append((doc, page, None, None, str(e)))
                yield pd.DataFrame(rows, columns=["doc_id", "page", "markdown", "blocks", "error"])

    return files.select("doc_id", "content").mapInPandas(run, PAGES)


# --- embeddings -------------------------------------------------------------------------------------------------------


def hashing_embedder(dim: int = 384) -> Callable[[pd.Series], pd.Series]:
    """A deterministic embedding by hashed words; blank texts are zero vectors."""

    def embed(texts: pd.Series) -> pd.Series:
        words = [t.lower().split() for t in texts.fillna("")]
        codes, distinct = pd.factorize(pd.Series([w for ws in words for w in ws], dtype=object))
        hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in distinct], np.uint64)
        row = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
        vectors = np.zeros((len(words), dim))
        if len(row):
            place, sign = (hashes % np.uint64(dim)).astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0)
            np.add.at(vectors, (row, place[codes]), sign[codes])
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        return pd.Series(list((vectors / np.where(norm > 0, norm, 1.0)).astype(np.float32)))

    return embed


def embed(texts: Column, embedder: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """Vectors of texts, in Arrow batches."""
    function = embedder or hashing_embedder()

    def run(batch: pd.Series) -> pd.Series:
        return function(batch)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<float>")(texts)


# --- language models --------------------------------------------------------------------------------------------------


class Provider(Protocol):
    """A language model: ``generate`` answers a prompt; ``model`` names it in cache keys."""

    model: str

    def generate(self, prompt: str, system_prompt: str | None = None) -> str: ...


class StubProvider:
    """Answers from the prompt's hash; for tests and dry runs."""

    def __init__(self, model: str = "stub") -> None:
        self.model = model

    def generate(self, prompt: str, system_prompt: str | None = None) -> str:
        return json.dumps([{"message_id": f"M{hashlib.sha256(prompt.encode()).hexdigest()[:4].upper()}"}])


class RateLimiter:
    """A token bucket for one worker: ``acquire`` waits until a token is there, and takes it."""

    def __init__(self, rate: float, capacity: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.capacity, self.tokens, self.clock, self.sleep = rate, capacity, capacity, clock, sleep
        self.at = clock()

    def acquire(self) -> None:
        while True:
            now = self.clock()
            self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rate), now
            if self.tokens >= 1:
                self.tokens -= 1
                return
            self.sleep((1 - self.tokens) / self.rate)


def with_retries(call: Callable[[], str], tries: int = 5, first: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Call until it works; waits double, with some chance in them, up to ``most`` seconds."""
    for n in range(tries):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if n == tries - 1:
                raise
            sleep(min(most, first * math.pow(2, n)) * (0.5 + random.random() / 2))
    raise AssertionError("unreachable")


PROVIDERS: dict[str, Callable[..., Provider]] = {"stub": StubProvider, "ollama": OllamaProvider, "chat": ChatProvider, "messages": MessagesProvider, "local": LocalProvider}


def provider(name: str, **options) -> Provider:
    """A registered provider that can be reached; others are added to ``PROVIDERS``."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; registered: {', '.join(sorted(PROVIDERS))}")
    made = PROVIDERS[name](**options)
    if not getattr(made, "available", lambda: True)():
        raise ConnectionError(f"provider {name!r} does not answer")
    return made


ANSWERS = "prompt_hash string, prompt_text string, response string, error string"


def generate(prompts: DataFrame, cache: DataFrame, model: Provider, calls_per_second: float | None = None, system_prompt: str | None = None, lanes: int = 8) -> DataFrame:
    """Answers for prompts (prompt_text): from the cache where a verified one is there, else from the model, each distinct prompt once.

    Returns prompt_hash, prompt_text, response, cached and error.  New answers are to be
    put in the cache unverified; a retried task asks again, under the same key.  With
    ``calls_per_second`` the prompts go to ``lanes`` tasks, each with its share of the rate.
    """
    keyed = prompts.withColumn("prompt_hash", prompt_hash(F.lit(model.model), F.col("prompt_text")))
    served = cache.where("is_verified").select("prompt_hash", F.coalesce("corrected_response", "original_response").alias("response"))
    hits = keyed.join(served, "prompt_hash").select("prompt_hash", "prompt_text", "response", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"))
    misses = keyed.join(served, "prompt_hash", "left_anti").select("prompt_hash", "prompt_text").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(calls_per_second / lanes, 1.0) if calls_per_second else None
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["prompt_hash"], batch["prompt_text"], strict=True):
                if limiter:
                    limiter.acquire()
                try:
                    rows.append((key, prompt, with_retries(lambda p=prompt: model.generate(p, system_prompt) if system_prompt else model.generate(p)), None))
                except Exception as e:  # noqa: BLE001  a failed call is a row
                    rows.append((key, prompt, None, str(e)))
            yield pd.DataFrame(rows, columns=["prompt_hash", "prompt_text", "response", "error"])

    if calls_per_second:
        misses = misses.repartition(lanes, "prompt_hash")
    answered = misses.mapInPandas(run, ANSWERS).select("prompt_hash", "prompt_text", "response", F.lit(False).alias("cached"), "error")
    return hits.unionByName(keyed.select("prompt_hash").join(answered, "prompt_hash"))
