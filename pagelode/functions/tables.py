"""Markdown tables as array expressions: headers ARRAY<STRING>, cells ARRAY<ARRAY<STRING>>.

Empty cells are dropped when a line is split, so later cells move left; that is how
such tables are read here throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.text import let

SEPARATOR = r"^[\|\-:\s]+$"


def table_lines(markdown: Column) -> Column:
    """The lines that are not blank, without blanks at their ends."""
    return F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def line_cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), lambda s: F.trim(s)), lambda s: s != "")


def fit(cells: Column, width: Column) -> Column:
    """Cut to the width, or filled up with empty cells."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)))), F.lit(1), width)


def parse_table(markdown: Column) -> Column:
    """Struct (headers, cells), null for what is no table: under three lines, or no rows."""

    def parts(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda s: s.rlike(SEPARATOR)), F.lit(True)).cast("int")
        separator = F.when(at > 0, at).otherwise(2)
        rows = F.filter(F.transform(F.slice(lines, separator + 1, F.greatest(F.size(lines) - separator, F.lit(0))), line_cells), lambda r: F.size(r) > 0)
        return F.when(F.size(lines) >= 3, F.struct(line_cells(F.get(lines, F.lit(0))).alias("headers"), rows.alias("rows")))

    def table(t: Column) -> Column:
        cells = F.transform(t["rows"], lambda r: fit(r, F.size(t["headers"])))
        return F.when((F.size(t["headers"]) > 0) & (F.size(t["rows"]) > 0), F.struct(t["headers"].alias("headers"), cells.alias("cells")))

    return let(let(table_lines(markdown), parts), table)


def has_columns(headers: Column, required: Column, exact: bool = False) -> Column:
    same = (lambda h, r: h == r) if exact else (lambda h, r: F.contains(F.lower(h), F.lower(r)))
    return F.forall(required, lambda r: F.exists(headers, lambda h: same(h, r)))


def column_index(headers: Column, name: Column, exact: bool = False) -> Column:
    """0-based place of the first header that is, or has in it, the name; null where none."""
    hit = F.transform(headers, lambda h: (h == name) if exact else F.contains(F.lower(h), F.lower(name)))
    at = F.array_position(hit, F.lit(True)).cast("int")
    return F.when(at > 0, at - 1)


def get_column(headers: Column, cells: Column, name: Column, exact: bool = False) -> Column:
    at = column_index(headers, name, exact)
    return F.when(at.isNotNull(), F.transform(cells, lambda r: F.get(r, at))).otherwise(F.array().cast("array<string>"))


def filter_rows(headers: Column, cells: Column, name: Column, value: Column, exact: bool = False) -> Column:
    """Rows, as maps, whose column holds (or is) the value."""
    at = column_index(headers, name)
    keep = F.filter(cells, lambda r: (F.get(r, at) == value) if exact else F.contains(F.lower(F.get(r, at)), F.lower(value)))
    return F.when(at.isNotNull(), F.transform(keep, lambda r: F.map_from_arrays(headers, r)))


def dict_rows(headers: Column, cells: Column) -> Column:
    """Rows as maps; with ``spark.sql.mapKeyDedupPolicy`` LAST_WIN a repeated header keeps its last cell."""
    return F.transform(cells, lambda r: F.map_from_arrays(headers, r))


def get_cell(markdown: Column, row: Column, column: Column) -> Column:
    """A cell by 0-based row (0: the header) and column; null outside the table."""
    lines = F.filter(table_lines(markdown), lambda s: ~F.startswith(s, F.lit("|--")))
    return F.get(line_cells(F.get(lines, row)), column)


def header_like(headers: Column, patterns: tuple[str, ...]) -> Column:
    """0-based place of the first header that matches any pattern."""
    joined = "|".join(patterns)
    hit = F.transform(headers, lambda h: F.lower(h).rlike(joined))
    return let(F.array_position(hit, F.lit(True)).cast("int"), lambda at: F.when(at > 0, at - 1))
