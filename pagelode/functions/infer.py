"""Field types, enumeration values and analyte names from text, as one expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.text import contains_any, let

# Phrases and names that decide a type or are recognised as they stand.
CODE_WORDS = ("code", "cd", "identifier")
LIST_PHRASES = ("values are", "possible values", "either", "always:", "one of", "can be")
COUNT_WORDS = ("number", "integer", "count", "quantity", "qty")
FLOAT_WORDS = ("float", "decimal", "percent")
FLAG_WORDS = ("flag", "boolean", "true/false")
TIME_WORDS = ("date", "time", "dttm", "timestamp")
BOOL_EXAMPLES = ("true", "false", "yes", "no", "0", "1")
COMMON_WORDS = (
    "empty", "example", "value", "values", "field", "code", "string", "number", "integer", "text", "data", "or", "and",
    "the", "a", "an", "is", "are", "be", "in", "for", "to",
)
ALWAYS = r"""[Aa]lways:\s*["']?([A-Z_][A-Z0-9_]*)["']?"""
VALUES_LIST = r"(?:[Pp]ossible\s+)?values?\s+(?:are|include)[:\s]+([^.]+)"
EITHER_OR = r"""[Ee]ither\s+["']?([A-Z_][A-Z0-9_]*)["']?\s+or\s+["']?([A-Z_][A-Z0-9_]*)["']?"""
ONE_OF = r"[Oo]ne\s+of[:\s]+([^.]+)"
XML_VALUE = r"""V=["']([^"']+)["']"""
KNOWN_ANALYTES = (
    "Flu A", "Flu B", "Influenza A", "Influenza B", "Strep A", "Streptococcus A", "Group A Strep", "RSV", "Respiratory Syncytial Virus",
    "COVID", "COVID-19", "SARS-CoV-2", "Coronavirus", "hCG", "Troponin", "D-Dimer", "CRP", "Procalcitonin", "Malaria", "Dengue", "HIV", "HBsAg", "HCV",
)
ANALYTE_LISTS = (r"(?i)analyte[s]?\s*[:\-]\s*([^.\n]+)", r"(?i)test\s+type[s]?\s*[:\-]\s*([^.\n]+)", r"(?i)assay[s]?\s*[:\-]\s*([^.\n]+)", r"(?i)observation[_\s]id[:\-]\s*([^.\n]+)")
NOT_ANALYTES = ("example", "n/a", "none", "empty", "-", "col", "field")


def field_type(name: Column, description: Column, example: Column) -> Column:
    """string, datetime, int, float, bool or code: the description decides before the name, the name before the example."""
    n, d = F.lower(name), F.lower(F.coalesce(description, F.lit("")))
    e = F.trim(F.btrim(F.coalesce(example, F.lit("")), F.lit('"')))
    return (
        F.when(contains_any(d, ("string", "text")), "string")
        .when(contains_any(d, CODE_WORDS) & contains_any(d, LIST_PHRASES), "code")
        .when(contains_any(d, COUNT_WORDS), "int")
        .when(contains_any(d, FLOAT_WORDS), "float")
        .when(contains_any(d, FLAG_WORDS), "bool")
        .when(F.endswith(n, F.lit("_cd")) | F.contains(n, F.lit("_code")), "code")
        .when(F.contains(n, F.lit("id")) & F.contains(d, F.lit("identify")), "string")
        .when(contains_any(n, TIME_WORDS), "datetime")
        .when(F.regexp_replace(e, "[-:T]", "").rlike(r"^\d{14}") | e.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), "datetime")
        .when(e.rlike(r"^-?\d+$"), "int")
        .when(e.rlike(r"^-?\d+\.\d+$"), "float")
        .when(F.lower(e).isin(*BOOL_EXAMPLES), "bool")
        .otherwise("string")
    )


def is_enum_value(v: Column) -> Column:
    """Whether a token looks like a code: one capital or digit; or capitals, digits and underscores that are no common word."""
    upper = (F.upper(v) == v) & v.rlike("[A-Za-z]")
    longer = v.rlike(r"(?i)^[A-Z0-9][A-Z0-9_]*$") & (upper | F.contains(v, F.lit("_")) | v.rlike(r"^\d+$")) & ~((F.length(v) > 2) & F.lower(v).isin(*COMMON_WORDS))
    return F.coalesce(F.when(F.length(v) == 1, v.rlike("^[A-Z0-9]$")).otherwise(longer), F.lit(False))


def value_list(text: Column) -> Column:
    """The codes in a list set apart by commas, 'or' and 'and'."""
    found = F.flatten(F.transform(F.split(text, r"[,]|\s+or\s+|\s+and\s+"), lambda p: F.regexp_extract_all(p, F.lit(r"[A-Z_][A-Z0-9_]*"), F.lit(0))))
    return F.filter(found, is_enum_value)


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<br\s*/?>", " "), r"<[^>]+>", "")


def _enum(values: Column, default: bool = False) -> Column:
    return F.transform(F.filter(values, is_enum_value), lambda v: F.struct(F.lit(not default).alias("rank"), v.alias("value"), F.lit(default).alias("is_default")))


def enum_values(type_: Column, description: Column, example: Column) -> Column:
    """Values of a code field as structs (value, is_default), defaults first, then by value; null where none or another type.

    Plain texts, what a pattern finds and the values themselves are each made once a field.
    """
    group = lambda t, p, g=1: F.regexp_extract(t, p, g)
    one = lambda v: F.array(v)
    from_description = lambda d: F.concat(
        _enum(one(group(d, ALWAYS)), True), _enum(value_list(group(d, VALUES_LIST))), _enum(F.array(group(d, EITHER_OR), group(d, EITHER_OR, 2))),
        _enum(value_list(group(d, ONE_OF))), _enum(F.regexp_extract_all(d, F.lit(XML_VALUE), F.lit(1))),
    )
    in_list = lambda bare: F.concat(_enum(one(bare)), F.when(F.contains(bare, F.lit(",")), _enum(value_list(bare))).otherwise(_enum(F.array().cast("array<string>"))))
    listed = lambda e: F.concat(let(F.btrim(F.btrim(F.trim(e), F.lit('"')), F.lit("'")), in_list), _enum(F.regexp_extract_all(e, F.lit(XML_VALUE), F.lit(1))))
    from_example = lambda e: let(group(e, ALWAYS), lambda v: F.when(is_enum_value(v), _enum(one(v), True)).otherwise(listed(e)))
    found = F.array_sort(F.array_distinct(F.concat(let(_plain(description), from_description), let(_plain(example), from_example))))
    values = F.transform(found, lambda x: F.struct(x["value"].alias("value"), x["is_default"].alias("is_default")))
    return F.when(type_ == "code", let(values, lambda v: F.when(F.size(v) > 0, v)))


def analyte_name(raw: Column) -> Column:
    """A name without quotes, carets and a leading label; null for what is no name."""
    clean = F.trim(F.replace(F.trim(F.btrim(raw, F.lit("\"'"))), F.lit("^^^"), F.lit("")))
    clean = F.trim(F.regexp_replace(clean, r"(?i)^(test|assay|analyte)[:\s]*", ""))
    return F.when((F.length(clean) >= 2) & ~F.lower(clean).isin(*NOT_ANALYTES), clean)


def analytes_in(text: Column) -> Column:
    """Names in labelled lists, then known names found as words."""
    listed = F.flatten(F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda s: F.split(F.trim(s), ",")) for p in ANALYTE_LISTS)))
    known = F.array(*(F.when(text.rlike(r"(?i)\b\Q" + k + r"\E\b"), F.lit(k)) for k in KNOWN_ANALYTES))
    return F.filter(F.concat(F.transform(listed, analyte_name), known), lambda s: s.isNotNull())
