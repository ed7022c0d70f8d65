"""Column functions against small hand-made cases and plain Python versions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pagelode.functions import confidence, geometry, hashing, impact, infer, tables
from pagelode.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def box(*xs):
    return geometry.bbox(*map(F.lit, xs))


BASE, OVER, APART = (100, 200, 500, 400), (300, 300, 600, 500), (600, 600, 700, 700)


@pytest.mark.parametrize(
    ("column", "wanted"),
    [
        (lambda: geometry.overlap(box(*BASE), box(*OVER)), True),
        (lambda: geometry.overlap(box(*BASE), box(*APART)), False),
        (lambda: geometry.overlap(box(0, 0, 10, 10), box(10, 0, 20, 10)), False),
        (lambda: geometry.touch(box(0, 0, 10, 10), box(10, 0, 20, 10)), True),
        (lambda: geometry.manhattan(box(*BASE), box(*OVER)), 250.0),
        (lambda: geometry.iou(box(*BASE), box(*OVER)), 20000 / 120000),
        (lambda: geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), 0.0),
        (lambda: geometry.contains(box(0, 0, 9, 9), box(0, 0, 9, 9)), True),
        (lambda: geometry.contains_point(box(0, 0, 9, 9), F.lit(9.0), F.lit(0.0)), True),
        (lambda: geometry.valid(box(0, 0, 0, 5)), False),
        (lambda: geometry.ordered(box(0, 0, 0, 5)), True),
        (lambda: geometry.area(box(*BASE)), 80000.0),
        (lambda: geometry.cited_distance(box(*BASE), F.lit(1), box(*BASE), F.lit(2)), float("inf")),
        (lambda: geometry.mostly_inside(box(0, 0, 10, 10), box(0, 0, 10, 5)), False),
        (lambda: geometry.near(box(0, 0, 2, 2), box(6, 8, 8, 10)), True),
        (lambda: geometry.spans_overlap(F.lit(1), F.lit(0), F.lit(5), F.lit(1), F.lit(5), F.lit(9)), False),
        (lambda: confidence.level(F.lit(0.5)), "review"),
        (lambda: confidence.level(F.lit(0.8)), "accepted"),
        (lambda: confidence.level(F.lit(0.49)), "rejected"),
        (lambda: confidence.search(F.array(F.lit(0.8))), pytest.approx(0.8 * 0.7 + 0.15)),
        (lambda: confidence.search(F.array().cast("array<double>")), 0.0),
        (lambda: confidence.weighted({"a": (F.lit(1.0), 3.0), "b": (F.lit(0.0), 1.0)}), 0.75),
        (lambda: confidence.last_weight_mean([(F.lit(1.0), 1.0), (F.lit(1.0), 0.5)]), 0.5),
        (lambda: confidence.schema_errors(F.lit(20)), 0.0),
        (lambda: T.tokens(F.lit("  The Cat sat ")), ["the", "cat", "sat"]),
        (lambda: T.tokens(F.lit(None)), []),
        (lambda: T.safe_filename(F.lit(" a/b:c?. ")), "a_b_c_"),
        (lambda: T.safe_filename(F.lit(" .. ")), "unnamed"),
        (lambda: T.title_case(F.lit("vendor_specific")), "Vendor Specific"),
        (lambda: T.citation_id(F.lit(3), F.lit("table"), F.lit(2)), "p3_tbl2"),
        (lambda: T.citation_id(F.lit(3), F.lit("odd"), F.lit(2)), "p3_unk2"),
        (lambda: T.json_payload(F.lit('x ```json\n{"a": 1}\n``` y')), '{"a": 1}'),
        (lambda: T.json_payload(F.lit('see {"a": [1]} ok')), '{"a": [1]}'),
        (lambda: T.json_payload(F.lit('see [{"a": 1}] ok')), '[{"a": 1}]'),
        (lambda: hashing.extraction_hash(F.lit(None).cast("string")), hashlib.sha256(b"empty_extraction").hexdigest()),
        (lambda: hashing.block_hash(F.lit(None).cast("string"), F.lit(None).cast("int")), hashlib.sha256(b"content:|page:0|source:unknown").hexdigest()),
    ],
)
def test_values(spark, column, wanted):
    assert value(spark, column()) == wanted


@pytest.mark.parametrize(
    ("name", "description", "example", "wanted"),
    [
        ("HDR.id", "A string to identify", "00001", "string"),
        ("HDR.x", "", "00001", "int"),
        ("X.timeout", "", "5", "datetime"),
        ("X.role", "Code. Possible values are A or B", None, "code"),
        ("X.role_cd", "", None, "code"),
        ("X.n", "Number of results", None, "int"),
        ("X.p", "percent done", None, "float"),
        ("X.f", "A flag", None, "bool"),
        ("X.v", "", "20240101120000", "datetime"),
        ("X.v", "", "-1.5", "float"),
        ("X.v", "", "yes", "bool"),
        ("X.v", "", "1", "int"),
        ("X.v", None, None, "string"),
    ],
)
def test_field_type(spark, name, description, example, wanted):
    assert value(spark, infer.field_type(F.lit(name), F.lit(description).cast("string"), F.lit(example).cast("string"))) == wanted


@pytest.mark.parametrize(("v", "ok"), [("R", True), ("1", True), ("r", False), ("-", False), ("ON_OFF", True), ("EXAMPLE", False), ("OR", True), ("abc", False), ("a_b", True), ("123", True), ("", False)])
def test_is_enum_value(spark, v, ok):
    assert value(spark, infer.is_enum_value(F.lit(v))) is ok


def enum(spark, description, example):
    found = value(spark, infer.enum_values(F.lit("code"), F.lit(description).cast("string"), F.lit(example).cast("string")))
    return found and [(r["value"], r["is_default"]) for r in found]


def test_enum_values(spark):
    assert enum(spark, "Always: 'START'. One of: STOP, GO", None) == [("START", True), ("GO", False), ("STOP", False)]
    assert enum(spark, "Either 'ON' or 'OFF'", 'Always: "ON"') == [("ON", True), ("OFF", False), ("ON", False)]
    assert enum(spark, 'As <x V="ABC"/> or V="D1"', "E1, F1") == [("D1", False), ("E1", False), ("F1", False)]
    assert enum(spark, "nothing here", None) is None
    assert value(spark, infer.enum_values(F.lit("int"), F.lit("Always: A"), F.lit("A"))) is None


def test_analytes(spark):
    assert value(spark, infer.analytes_in(F.lit("Analytes: Glucose, none, 'K+'\nTests for flu a and COVID-19."))) == ["Glucose", "'K+", "Flu A", "COVID", "COVID-19"]
    assert value(spark, infer.analyte_name(F.lit('"Test: ^^^Sodium"'))) == "Sodium"


@pytest.mark.parametrize(
    ("old", "new", "kind", "wanted"),
    [
        (None, "Message OBS.R01", "text", ("HIGH", "MESSAGE_ADDED")),
        (None, "MSH-9 R name", "table", ("HIGH", "FIELD_ADDED")),
        (None, "MSH-9 O name", "table", ("MEDIUM", "FIELD_ADDED")),
        (None, "MSH-9 O name", "text", ("LOW", "BLOCK_ADDED")),
        (None, "Segment ZPX here", "text", ("MEDIUM", "VENDOR_EXTENSION_MODIFIED")),
        ("Message OBS.R01", None, "text", ("HIGH", "MESSAGE_REMOVED")),
        ("MSH-9 O", None, "table", ("HIGH", "BLOCK_REMOVED")),
        ("words", None, "text", ("LOW", "BLOCK_REMOVED")),
        ("Field: a", "Field: b", "table", ("HIGH", "FIELD_RENAMED")),
        ("type ST", "type NM", "table", ("HIGH", "FIELD_TYPE_CHANGED")),
        ("x R", "x O", "table", ("HIGH", "CARDINALITY_CHANGED")),
        ("a b", " a b ", "text", ("LOW", "WHITESPACE_CHANGED")),
        ("a b", "A b", "text", ("LOW", "TYPO_FIXED")),
        ("a b", "a  b", "text", ("LOW", "DOCUMENTATION_UPDATED")),
        ("a", "b", "table", ("MEDIUM", "TABLE_STRUCTURE_CHANGED")),
        (None, None, "text", ("LOW", "WHITESPACE_CHANGED")),
    ],
)
def test_impact(spark, old, new, kind, wanted):
    found = value(spark, impact.change(F.lit(old).cast("string"), F.lit(new).cast("string"), F.lit(kind)))
    assert (found["level"], found["change_type"]) == wanted


TABLE = "| A | B | C |\n|---|:-:|---|\n| 1 | | 3 |\n| 4 | 5 | 6 | 7 |\n"


def test_tables(spark):
    t = value(spark, tables.parse_table(F.lit(TABLE)))
    assert t["headers"] == ["A", "B", "C"]
    assert t["cells"] == [["1", "3", ""], ["4", "5", "6"]]  # the empty cell is dropped, so 3 moves left
    assert value(spark, tables.parse_table(F.lit("| A |\n|---|"))) is None
    assert value(spark, tables.get_cell(F.lit(TABLE), F.lit(1), F.lit(1))) == "3"
    assert value(spark, tables.get_cell(F.lit(TABLE), F.lit(7), F.lit(1))) is None
    rows = value(spark, tables.filter_rows(F.array(F.lit("Name"), F.lit("V")), F.array(F.array(F.lit("ab"), F.lit("1")), F.array(F.lit("c"), F.lit("2"))), F.lit("name"), F.lit("B")))
    assert rows == [{"Name": "ab", "V": "1"}]


@pytest.mark.parametrize("pattern", [r"(?i)th[a-z]+", r"a", r"\d+", r"x|yz"])
def test_match_spans(spark, pattern):
    for text in ["The thing, éther a1a22", "aaa", "", "xyzx", "none here" * 3]:
        found = value(spark, T.match_spans(F.lit(text), pattern))
        assert [(m["start"], m["end"], m["match"]) for m in found] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text)]


def test_keyword_pattern():
    for word in ["a.b", "(x)", "1+1", "[a-z]", "plain"]:
        assert re.search(T.keyword_pattern(word), f"see {word.upper()} here")
