"""Text functions: tokens, detectors, previews, names, headings and match positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what is recognised.
MESSAGE_TYPE = r"\b([A-Z]{3})\.[A-Z]\d{2}\b"
MESSAGE_CARET = r"\b([A-Z]{3})\^([A-Z]{3}_[A-Z]\d{2})\b"
MESSAGE_ANY = r"\b([A-Z]{3,})[.^_]([A-Z]+\d+)\b"
MESSAGE_SEGMENTS = r"\b[A-Z][a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)+\b"
VENDOR = r"\bZ[A-Z]{2}"
VENDOR_LONG = r"\bZ[A-Z0-9]{2,}"
MESSAGE_PATTERNS = (MESSAGE_TYPE, MESSAGE_CARET, MESSAGE_ANY, MESSAGE_SEGMENTS, VENDOR, VENDOR_LONG)
FIELD = r"\b([A-Z]{3})-(\d+)\b"
FIELD_DOT = r"\b([A-Z]{3})\.(\d+)\b"
FIELD_ANY = r"\b([A-Z]{2,})[-._](\d+)\b"
FIELD_NAME = r"(?i)(?:Field|Name):\s*([A-Za-z_][A-Za-z0-9_]*)"
DATA_TYPE = r"\b(ST|NM|CX|CE|TS|DTM|ID|IS|TX|FT|DT|TM)\b"
OPTIONALITY = r"\b([ROC])(?:\[\d+\.\.\d+\])?\b"
VENDOR_SEGMENT = r"\bZ[A-Z]{2}\b"
HEADING = r"(?md)^(#{1,6})\s+(.+)$"
IMAGE = r"!\[([^\]]*)\]\(([^\)]+)\)"
CAPTION = r"(?i)\b(Figure\s+\d+|Fig\.\s*\d+|Table\s+\d+|Diagram\s+\d+|Chart\s+\d+)"


#: White space beyond the six ASCII characters, as a class of Java's and RE2's patterns.
UNICODE_SPACES = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def tokens(text: Column) -> Column:
    """Lower-cased words between Unicode white space; none for null."""
    space = r"[\s" + UNICODE_SPACES[1:] + "+"
    trimmed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"^{space}|{space}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, space))


def contains_ci(text: Column, part: Column | str) -> Column:
    part = F.lit(part) if isinstance(part, str) else part
    return F.contains(F.lower(text), F.lower(part))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def message_prefixes(text: Column) -> Column:
    """The three letters of each message type named, in order."""
    return F.regexp_extract_all(text, F.lit(MESSAGE_TYPE), F.lit(1))


def field_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FIELD), F.lit(0))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def preview(text: Column, length: int) -> Column:
    """The text, or its first ``length`` characters and an ellipsis."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def safe_filename(name: Column) -> Column:
    """Characters that file systems refuse become underscores; blanks and dots at the ends go; nothing left: 'unnamed'."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), F.lit(". ")), F.lit("")), F.lit("unnamed"))


def safe_citation(citation: Column) -> Column:
    return F.regexp_replace(citation, r"[^A-Za-z0-9_-]", "_")


def session_name(file_name: Column, at: Column) -> Column:
    """Time and the first twenty letters or digits of a name without its version mark."""
    stem = F.regexp_replace(file_name, r"(?i)[_-](v\d+|version\d+|\d{4,8})", "")
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd_HHmmss"), F.left(F.regexp_replace(stem, r"[^A-Za-z0-9]", ""), F.lit(20)))


def citation_id(page: Column, kind: Column, ordinal: Column) -> Column:
    """p{page}_{kind}{n}; n counts from 1 over blocks of all kinds in reading order."""
    short = F.when(kind == "text", "txt").when(kind == "picture", "img").when(kind == "table", "tbl").when(kind == "graphics", "gfx").otherwise("unk")
    return F.concat(F.lit("p"), page.cast("string"), F.lit("_"), short, ordinal.cast("string"))


def citation_source(kind: Column) -> Column:
    return F.when(kind.isin("text", "table"), "text").otherwise("graphics")


def table_ref(page: Column, number: Column, fallback: bool = False) -> Column:
    return F.concat(F.lit("table_"), page.cast("string"), F.lit("_text_" if fallback else "_"), number.cast("string"))


def footnote(citation: Column, page: Column, box: Column, source: Column, confidence: Column | None = None, level: Column | None = None, review: Column | None = None, file: Column | None = None) -> Column:
    """A citation as a markdown footnote; parts that are null are left out."""
    parts = [F.format_string("[^%s]: Page %d, bbox [%.1f, %.1f, %.1f, %.1f], source: %s", citation, page, box["x0"], box["y0"], box["x1"], box["y1"], source)]
    if confidence is not None:
        parts.append(F.when(confidence.isNotNull(), F.format_string(", confidence: %.2f", confidence)))
    if level is not None:
        parts.append(F.when(level.isNotNull(), F.concat(F.lit(", level: "), level)))
    if review is not None:
        parts.append(F.when(review, F.lit(" [NEEDS REVIEW]")))
    if file is not None:
        parts.append(F.when(file.isNotNull(), F.concat(F.lit(", file: "), file)))
    return F.concat_ws("", *parts)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Matches whose places are summed together.
_RUN = 256


def match_spans(text: Column, pattern: str, limit: int | None = None) -> Column:
    """Matches (the first ``limit``) as an array of structs (start, end, match), 0-based and half-open, without a Python function.

    The text between matches and the matches themselves are both known natively;
    running lengths of the two give the positions, by sums of runs of matches and then
    within a run, so that a text with very many matches costs little more for each.
    The pattern must not match the empty string.
    """
    gaps = F.transform(F.split(text, pattern, -1 if limit is None else limit + 1), lambda s: F.length(s))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(gaps.alias("gaps"), (found if limit is None else F.slice(found, 1, limit)).alias("found")), lambda t: spans_of(t["gaps"], t["found"]))


def spans_of(gaps: Column, found: Column) -> Column:
    """Spans of matches from the lengths of the texts before each."""
    add = lambda a, x: a + x
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, s: g + F.length(s))
    runs = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _RUN).cast("int"))
    by_run = lambda t: F.transform(runs, lambda r: total(F.slice(t, r * _RUN + 1, F.lit(_RUN))))
    before = lambda sums: F.transform(runs, lambda r: total(F.slice(sums, F.lit(1), r)))

    def spans(t: Column) -> Column:
        def place(s: Column, i: Column) -> Column:
            run = F.floor(i / _RUN).cast("int")
            start = F.get(t["before"], run) + total(F.slice(t["steps"], run * _RUN + 1, i % _RUN)) + F.get(gaps, i)
            return F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("match"))

        return F.transform(found, place)

    whole = let(steps, lambda t: let(by_run(t), lambda sums: let(F.struct(t.alias("steps"), before(sums).alias("before")), spans)))
    return F.when(F.size(found) > 0, whole).otherwise(F.array().cast("array<struct<start: int, end: int, match: string>>"))


def keyword_pattern(keyword: str) -> str:
    """A case-blind pattern that matches a keyword literally."""
    return "(?i)" + "".join("\\" + c if c in r"\.^$|?*+()[]{}-&~#" else c for c in keyword)


def json_payload(response: Column) -> Column:
    """The JSON in a model's answer: in a json fence, else in a plain fence, else from the first bracket to its last partner."""
    fenced = F.regexp_extract(response, r"(?s)```json\s*(.*?)```", 1)
    plain = F.regexp_extract(response, r"(?s)```\s*(.*?)```", 1)
    array, object_ = F.regexp_extract(response, r"(?s)(\[.*\])", 1), F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    a, o = F.instr(response, "["), F.instr(response, "{")
    bare = F.when((a > 0) & ((o == 0) | (a < o)) & (array != ""), array).when(object_ != "", object_).when(array != "", array).otherwise(response)
    return F.btrim(F.when(response.rlike(r"(?s)```json.*?```"), fenced).when(response.rlike(r"(?s)```.*?```"), plain).otherwise(bare), F.lit(" \t\r\n"))
