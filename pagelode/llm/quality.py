"""Quality rules: zstandard compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import arrow_map, bounds, byte_slices, named, rest_of, row_sums, schema_of, split_words

#: Accepted ratio (bytes / compressed bytes) by length in bytes: (up to, least, most).  Set on labelled clean prose
#: of the sample tables with room on either side; a short text shows little of its redundancy, so its band is wider.
#: Ratios go on rising with length: above 25,600 bytes the bands stand on clean texts joined by language (German, the
#: highest: 2.76 at 400 KB, 2.79 at 800 KB, 2.81 at 1.3 MB); beyond that only English was long enough (2.62 at 3.2 MB).
BANDS = (
    (100, 0.0, 1.8), (200, 0.7, 2.0), (400, 1.0, 2.0), (800, 1.2, 2.1), (1600, 1.35, 2.25), (3200, 1.5, 2.32),
    (6400, 1.6, 2.42), (12800, 1.7, 2.5), (25600, 1.7, 2.62), (204800, 1.7, 2.8),
    (409600, 1.7, 2.9), (819200, 1.7, 2.95), (1638400, 1.7, 3.0), (float("inf"), 1.7, 3.05),
)
CHUNK = 4096
CHUNK_BAND = (1.5, 2.42)
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_chunks_outside long, base_failed boolean, kept boolean"

_WHITE = np.zeros(256, np.bool_)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_STARTS = np.ones(256, np.bool_)  # bytes that begin a code point
_STARTS[0x80:0xC0] = False
_IN_WORD = _STARTS & ~_WHITE
_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[list(SYMBOLS)] = True


def _windows(codes: np.ndarray, edges: np.ndarray, width: int) -> np.ndarray:
    """For each row the number of words inside a window of ``width`` words that occurs twice or more in the row.

    Windows are compared by a 64-bit mix of their words' codes and the row; each that seems to recur is then compared word for word.
    """
    total = len(codes)
    if total < width:
        return np.zeros(len(edges) - 1, np.int64)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    mix = row[: total - width + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        mix ^= codes[k : total - width + 1 + k].astype(np.uint64) + np.uint64(0x9E3779B9)
        mix *= np.uint64(0xBF58476D1CE4E5B9)
        mix ^= mix >> np.uint64(29)
    whole = np.flatnonzero(row[: total - width + 1] == row[width - 1 :])
    order = whole[np.argsort(mix[whole], kind="stable")]
    same = mix[order][1:] == mix[order][:-1]
    covered = np.zeros(total + 1, np.int64)
    if same.any():
        alike = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        found = order[alike]
        words = np.stack([row[found], *(codes[found + k] for k in range(width))], axis=1)
        _, inverse, count = np.unique(words, axis=0, return_inverse=True, return_counts=True)
        found = found[count[inverse.ravel()] > 1]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + width, -1)
    return row_sums(np.cumsum(covered)[:-1] > 0, edges)


def _repeats(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Items of each row that equal an earlier one of the same row."""
    if not len(keys):
        return np.zeros(rows, np.int64)
    order = np.lexsort((keys, row))
    again = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=rows)


def measure(texts: pa.Array, bands: tuple = BANDS, chunk: int = CHUNK, chunk_band: tuple[float, float] = CHUNK_BAND, level: int = LEVEL) -> dict[str, np.ndarray]:
    """All measures of a block of texts; a null is an empty text."""
    texts = texts.fill_null("").combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.fill_null("")
    n = len(texts)
    words, counts = split_words(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, count=n + 1, offset=4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    lines = pc.split_pattern(texts, "\n")
    per_text = pc.list_value_length(lines).to_numpy()
    lines = lines.flatten()
    worded = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line_row = np.repeat(np.arange(n), per_text)[worded]
    line_code = lines.dictionary_encode().indices.to_numpy()[worded]

    squeeze = zstandard.ZstdCompressor(level=level).compress
    whole, outside, chunks = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    view = memoryview(data)
    sizes = np.diff(edges)
    for i in range(n):
        a, b = int(edges[i]), int(edges[i + 1])
        if a == b:
            continue
        whole[i] = (b - a) / len(squeeze(view[a:b]))
        if b - a >= chunk:
            begins = [*range(a, b - chunk + 1, chunk), *([b - chunk] if (b - a) % chunk else [])]  # the last full chunk ends where the text does
            chunks[i] = len(begins)
            outside[i] = sum(not chunk_band[0] <= chunk / len(squeeze(view[k : k + chunk])) <= chunk_band[1] for k in begins)
    band = np.searchsorted([b[0] for b in bands], sizes)
    least, most = np.array([b[1] for b in bands])[band], np.array([b[2] for b in bands])[band]
    repeat = _windows(codes, bounds(counts), WINDOW)
    failed = (counts < 10) | (100 * repeat > 20 * counts)
    inside = (whole >= least) & (whole <= most) & (2 * outside <= chunks)
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": row_sums(_IN_WORD[data], edges),
        "n_symbols": row_sums(_SYMBOL[data], edges),
        "n_dup_lines": _repeats(line_code, line_row, n).astype(np.int64),
        "n_repeat_words": repeat,
        "ratio": whole,
        "n_chunks": chunks,
        "n_chunks_outside": outside,
        "base_failed": failed,
        "kept": ~failed & inside,
    }


def compression_bands(df: DataFrame, text: str = "text", bands: tuple = BANDS, chunk: int = CHUNK, chunk_band: tuple[float, float] = CHUNK_BAND, level: int = LEVEL, keep_columns: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Measure each document and decide whether it stays.

    A document fails the base rules with fewer than ten words, or if over a fifth of
    its words lie in five-word windows that recur in it.  Of the others one is
    rejected if the zstandard ratio of the whole text lies outside the band for its
    length (above: repetitive or tabular; below: incompressible), or if over half of
    its ``chunk``-byte chunks lie outside ``chunk_band``: full chunks from the start on,
    and a last one that ends with the text, so every byte of a long text is in one.
    Chunks see what a long text's average hides.

    Returns ``keep_columns`` (default: all but the text) and the measures; with
    ``only_kept`` the rows that stay, in the input's columns.  A narrow stage: no
    shuffle, memory bounded by a slice of text, or by a text that is longer.  Null and
    empty texts: no words, ratio 0, base_failed.  Repeated rows are judged alike, each
    returned.  An empty table gives no rows.  Columns may have any name; those of ``df``
    named like a measure are left out of the measured result.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    columns = df.columns if only_kept else [c for c in (keep_columns if keep_columns is not None else df.columns) if c.lower() not in {text.lower(), *names}]
    rest = [c for c in columns if c != text]
    used = df.select(named(df, text).cast("string").alias("text"), rest_of(df, *(c for c in df.columns if c not in rest)).alias("rest"))
    kept = [("rest", used.schema["rest"].dataType)]
    measures = [tuple(f.split()) for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in byte_slices(whole, "text", 2 << 20):
                found = measure(part.column("text").cast(pa.string()), bands, chunk, chunk_band, level)
                if only_kept:
                    yield part.filter(pa.array(found["kept"]))
                else:
                    yield pa.RecordBatch.from_arrays([part.column("rest"), *(pa.array(found[k]) for k in names)], names=["rest", *names])

    found = arrow_map(used, run, schema_of(("text", "string"), *kept) if only_kept else schema_of(*kept, *measures))
    return found.select(*(F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in columns), *([] if only_kept else names))
