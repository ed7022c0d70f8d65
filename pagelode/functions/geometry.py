"""Bounding boxes as structs of x0, y0, x1, y1 (doubles); every function is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def _sides(b: Column) -> tuple[Column, Column, Column, Column]:
    return b["x0"], b["y0"], b["x1"], b["y1"]


def valid(b: Column) -> Column:
    """An area above zero."""
    return (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])


def ordered(b: Column) -> Column:
    """Corners in order; a line or point is allowed, as in citations."""
    return (b["x1"] >= b["x0"]) & (b["y1"] >= b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Interiors meet; touching edges do not count."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def touch(a: Column, b: Column) -> Column:
    """Interiors or edges meet."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def center(b: Column) -> tuple[Column, Column]:
    return (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2


def manhattan(a: Column, b: Column) -> Column:
    """Between centres."""
    (ax, ay), (bx, by) = center(a), center(b)
    return F.abs(ax - bx) + F.abs(ay - by)


def cited_distance(a: Column, page_a: Column, b: Column, page_b: Column) -> Column:
    """Manhattan distance on one page, infinite across pages."""
    return F.when(page_a == page_b, manhattan(a, b)).otherwise(F.lit(float("inf")))


def euclidean(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def near(a: Column, b: Column, tolerance: float = 10.0) -> Column:
    return euclidean(a, b) <= tolerance


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def shared_area(a: Column, b: Column) -> Column:
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when(overlap(a, b), wide * high).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Shared area over that of the union; 0 where there is none."""
    both = area(a) + area(b) - shared_area(a, b)
    return F.when(both > 0, shared_area(a, b) / F.nullif(both, F.lit(0.0))).otherwise(0.0)


def share_of_first(a: Column, b: Column) -> Column:
    return F.when(area(a) > 0, shared_area(a, b) / F.nullif(area(a), F.lit(0.0))).otherwise(0.0)


def mostly_inside(a: Column, b: Column, share: float = 0.5) -> Column:
    return share_of_first(a, b) > share


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def contains_point(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def merge(boxes: Column) -> Column:
    """Aggregate: the box around all boxes; zeros where there are none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return bbox(zero(F.min(boxes["x0"])), zero(F.min(boxes["y0"])), zero(F.max(boxes["x1"])), zero(F.max(boxes["y1"])))


def clip(b: Column, width: Column, height: Column, padding: float = 0.0) -> Column:
    """Padded on each side, then kept within the page."""
    return bbox(
        F.greatest(b["x0"] - padding, F.lit(0.0)), F.greatest(b["y0"] - padding, F.lit(0.0)), F.least(b["x1"] + padding, width), F.least(b["y1"] + padding, height)
    )


def zoom(dpi: Column) -> Column:
    return dpi / 72.0


def spans_overlap(page_a: Column, start_a: Column, end_a: Column, page_b: Column, start_b: Column, end_b: Column) -> Column:
    """Half-open text spans of one page."""
    return (page_a == page_b) & (start_a < end_b) & (start_b < end_a)
