"""Rectangle expressions over columns x, y, w, h (top-left origin, half-open), optionally with a suffix for each side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """The four columns of a rectangle; ``Box("_a")`` reads x_a, y_a, w_a and h_a."""

    def __init__(self, suffix: str = "", columns: tuple[Column, ...] | None = None):
        self.x, self.y, self.w, self.h = columns or (F.col(f"{c}{suffix}") for c in "xywh")

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(1), self.w * self.h)

    @property
    def aspect(self) -> Column:
        return F.greatest(self.w / F.greatest(F.lit(1), self.h), self.h / F.greatest(F.lit(1), self.w))

    @property
    def center2(self) -> tuple[Column, Column]:
        """Twice the centre, which is whole."""
        return self.x * 2 + self.w, self.y * 2 + self.h

    @property
    def diagonal_squared(self) -> Column:
        return self.w * self.w + self.h * self.h

    def expanded(self, pad: int) -> Box:
        return Box(columns=(self.x - pad, self.y - pad, self.w + 2 * pad, self.h + 2 * pad))

    def clamped(self, width: int, height: int) -> Box:
        """The part inside an image; w or h of 0 or less if there is none."""
        x, y = F.greatest(self.x, F.lit(0)), F.greatest(self.y, F.lit(0))
        return Box(columns=(x, y, F.least(self.x + self.w, F.lit(width)) - x, F.least(self.y + self.h, F.lit(height)) - y))


def intersection(a: Box, b: Box) -> Column:
    over = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    down = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.greatest(F.lit(0), over) * F.greatest(F.lit(0), down)


def union_area(a: Box, b: Box) -> Column:
    return a.area + b.area - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    return intersection(a, b) / F.greatest(F.lit(1), union_area(a, b))


def iom(a: Box, b: Box) -> Column:
    return intersection(a, b) / F.least(a.area, b.area)


def distance2_squared(a: Box, b: Box) -> Column:
    """Four times the squared distance of the centres."""
    (ax, ay), (bx, by) = a.center2, b.center2
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def center_ratio(a: Box, b: Box) -> Column:
    """Distance of the centres over the smaller diagonal."""
    return F.sqrt(distance2_squared(a, b) / 4) / F.sqrt(F.greatest(F.lit(1), F.least(a.diagonal_squared, b.diagonal_squared)))


def center_within(a: Box, b: Box) -> Column:
    """a's centre lies in b."""
    cx, cy = a.center2
    return cx.between(b.x * 2, (b.x + b.w) * 2) & cy.between(b.y * 2, (b.y + b.h) * 2)


def overlap_1d(a: Column, a_size: Column, b: Column, b_size: Column) -> Column:
    """Shared part of two spans over the shorter one."""
    shared = F.greatest(F.lit(0), F.least(a + a_size, b + b_size) - F.greatest(a, b))
    return shared / F.greatest(F.lit(1), F.least(a_size, b_size))


def gap_1d(a: Column, a_size: Column, b: Column, b_size: Column) -> Column:
    return F.greatest(F.lit(0), F.greatest(a, b) - F.least(a + a_size, b + b_size))


def clusters(a: Box, b: Box) -> Column:
    """Same physical object: overlap with IoU of at least .30 and centres within .28 of the smaller diagonal, or IoM of at
    least .72 with nested centres within .322. Whole-number arithmetic, so the bounds are exact."""
    # areas are 1 at least, so either bound asks for an overlap; inter * 100 >= (areas - inter) * 30 has inter once
    inter, far = intersection(a, b), distance2_squared(a, b) * 1_000_000
    diagonal = F.greatest(F.lit(1), F.least(a.diagonal_squared, b.diagonal_squared)) * 4
    near = (inter * 130 >= (a.area + b.area) * 30) & (far <= diagonal * 78_400)
    nested = (inter * 100 >= F.least(a.area, b.area) * 72) & (center_within(a, b) | center_within(b, a)) & (far <= diagonal * 103_684)
    return near | nested


def hue_distance(a: Column, b: Column) -> Column:
    """Circular, for hues of 0 to 179."""
    d = F.abs(a - b)
    return F.least(d, F.lit(180) - d)


def color_similarity(distance: Column) -> Column:
    return F.when(distance > 36, 0.0).otherwise(1 - distance / 36)


def area_bucket(area: Column) -> Column:
    # Bounds and names of the area buckets.
    return F.when(area < 10_000, "<10k").when(area < 50_000, "10k-50k").when(area < 100_000, "50k-100k").when(area < 200_000, "100k-200k").otherwise(">=200k")


def points_to_pixels(value: Column, dpi: int, origin: Column | float = 0) -> Column:
    return F.floor((value - F.lit(origin) if not isinstance(origin, Column) else value - origin) * dpi / 72.0 + 0.5)


def quarter_turn(dx: Column, dy: Column) -> Column:
    """The multiple of 90 degrees nearest to a direction."""
    return F.pmod(F.bround(F.degrees(F.atan2(dy, dx)) / 90) * 90, F.lit(360)).cast("long")
