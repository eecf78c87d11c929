"""Expressions over boxes: rectangles from rectangles or polygons, unions over spans, scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOX = "array<bigint>"


def _rounded(c: Column) -> Column:
    """Half to even, as whole numbers."""
    return F.bround(c).cast("long")


def rectangle(box: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """[x1, y1, x2, y2] of four numbers or of a flat polygon (six or more numbers, an even count); else null.

    With the picture's size, boxes within [0, 1] are scaled to pixels."""
    n = F.size(box)
    xs = F.transform(F.filter(box, lambda v, i: i % 2 == 0), lambda v: v)
    ys = F.filter(box, lambda v, i: i % 2 == 1)
    corners = F.when(n == 4, box).when((n >= 6) & (n % 2 == 0), F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    if width is not None and height is not None:
        scale = F.array(width, height, width, height)
        corners = F.when(F.array_max(corners) <= 1, F.zip_with(corners, scale, lambda a, b: a * b)).otherwise(corners)
    return F.transform(corners, _rounded)


def span_box(boxes: Column, start: Column, end: Column) -> Column:
    """The union of the tokens' rectangles in a span; null if there is none."""
    part = F.filter(F.transform(F.slice(boxes, start + 1, end - start + 1), lambda b: rectangle(b)), lambda b: b.isNotNull())
    side = lambda i: F.transform(part, lambda b: b[i])
    return F.when(F.size(part) > 0, F.array(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(2)), F.array_max(side(3))))


def per_mille(box: Column, width: Column, height: Column) -> Column:
    """A rectangle in thousandths of the picture, from 0 to 1000; zeros for none."""
    scale = F.array(width, height, width, height)
    scaled = F.zip_with(box, scale, lambda a, b: F.greatest(F.lit(0), F.least(F.lit(1000), _rounded(1000 * a / F.greatest(b, F.lit(1))))).cast("long"))
    return F.coalesce(scaled, F.array(*[F.lit(0)] * 4).cast(_BOX))


def span_boxes(boxes: Column, spans: Column) -> Column:
    """The box of each span that has one, in order."""
    return F.filter(F.transform(spans, lambda s: span_box(boxes, s["start"], s["end"])), lambda b: b.isNotNull())
