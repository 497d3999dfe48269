"""Geometry of page coordinates as pure Column expressions.

A box is four exact columns (left, top, width, height), y growing downwards; points and lines are
exact too. Everything here is arithmetic and CASE, so it stays within whole-stage code generation and
filters on it reach the scan. What has no result (an intersection of parted boxes) is a null struct.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed

SIDES = ("Top", "Bottom", "Right", "Left")
CORNERS = ("TopLeft", "BottomLeft", "TopRight", "BottomRight")
ADJACENT = ("Left", "BottomLeft", "TopLeft", "Top", "Bottom", "Right", "TopRight", "BottomRight")
BOX_TYPE = "struct<left:int,top:int,width:int,height:int>"
RIGHT_ANGLE_TOLERANCE = 0.08


def _col(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


class Point(NamedTuple):
    x: Column
    y: Column

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"))

    def __neg__(self) -> Point:
        return Point(-self.x, -self.y)

    def translate(self, dx: Column | int, dy: Column | int) -> Point:
        return Point(self.x + dx, self.y + dy)

    def plus(self, other: Point) -> Point:
        return Point(self.x + other.x, self.y + other.y)

    def minus(self, other: Point) -> Point:
        return self.plus(-other)

    def hdist(self, other: Point) -> Column:
        return fixed.as_double(other.x - self.x)

    def vdist(self, other: Point) -> Column:
        return fixed.as_double(other.y - self.y)

    def dist(self, other: Point) -> Column:
        x, y = self.hdist(other), self.vdist(other)
        return F.sqrt(x * x + y * y)

    def angle_to(self, other: Point) -> Column:
        """Upwards is positive, although y grows downwards."""
        return F.atan2(fixed.as_double(self.y - other.y), fixed.as_double(other.x - self.x))


class Line(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def struct(self) -> Column:
        return F.struct(self.x1.alias("x1"), self.y1.alias("y1"), self.x2.alias("x2"), self.y2.alias("y2"))

    def rise(self) -> Column:
        return fixed.as_double(self.y2 - self.y1)

    def run(self) -> Column:
        return fixed.as_double(self.x2 - self.x1)

    def angle(self) -> Column:
        return F.atan2(self.rise(), self.run())

    def slope(self) -> Column:
        """Null for upright lines."""
        return F.try_divide(self.rise(), self.run())

    def length(self) -> Column:
        return F.sqrt(self.run() * self.run() + self.rise() * self.rise())

    def before(self, other: Line) -> Column:
        """Whether this line comes first by first, then second point."""
        return self.struct() <= other.struct()

    def centre(self) -> Point:
        return Point(fixed.divide(self.x1 + self.x2, 2), fixed.divide(self.y1 + self.y2, 2))

    def sorted(self) -> Line:
        """Both x and both y in ascending order, each for itself."""
        return Line(F.least(self.x1, self.x2), F.least(self.y1, self.y2), F.greatest(self.x1, self.x2), F.greatest(self.y1, self.y2))

    def bounds(self) -> Box:
        s = self.sorted()
        return Box(s.x1, s.y1, s.x2 - s.x1, s.y2 - s.y1)

    def clip(self, box: Box) -> Line:
        """The sorted line within a box, on all four sides."""
        s = self.sorted()
        return Line(F.greatest(s.x1, box.left), F.greatest(s.y1, box.top), F.least(s.x2, box.right), F.least(s.y2, box.bottom))

    def extend_right(self, x: Column | int) -> Line:
        return Line(self.x1, self.y1, _col(x), self.y2)

    def extend_left(self, x: Column | int) -> Line:
        return Line(_col(x), self.y1, self.x2, self.y2)

    def split_vertical(self, x: Column | int) -> Column:
        """Struct of the lines left and right of x, null unless x is strictly inside."""
        s, x = self.sorted(), _col(x)
        halves = F.struct(Line(s.x1, s.y1, x, s.y2).struct().alias("l"), Line(x, s.y1, s.x2, s.y2).struct().alias("r"))
        return F.when((s.x1 < x) & (x < s.x2), halves)

    def translate(self, dx: Column | int, dy: Column | int) -> Line:
        return Line(self.x1 + dx, self.y1 + dy, self.x2 + dx, self.y2 + dy)


class Box(NamedTuple):
    left: Column
    top: Column
    width: Column
    height: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """Columns ``{prefix}l``, ``{prefix}t``, ``{prefix}w``, ``{prefix}h``."""
        return cls(*(F.col(f"{prefix}{c}") for c in "ltwh"))

    @classmethod
    def field(cls, struct: Column) -> Box:
        return cls(struct["left"], struct["top"], struct["width"], struct["height"])

    @classmethod
    def edges(cls, left: Column, top: Column, right: Column, bottom: Column) -> Box:
        return cls(left, top, right - left, bottom - top)

    @property
    def right(self) -> Column:
        return self.left + self.width

    @property
    def bottom(self) -> Column:
        return self.top + self.height

    def struct(self) -> Column:
        return F.struct(self.left.alias("left"), self.top.alias("top"), self.width.alias("width"), self.height.alias("height"))

    def where(self, condition: Column) -> Column:
        return F.when(condition, self.struct())

    def columns(self, prefix: str = "") -> list[Column]:
        return [x.alias(f"{prefix}{c}") for x, c in zip(self, "ltwh", strict=True)]

    # --- single boxes

    def to_low_left(self) -> Column:
        """The same box by its lower left corner."""
        return F.struct(self.left.alias("left"), self.bottom.alias("bottom"), self.width.alias("width"), self.height.alias("height"))

    @classmethod
    def from_low_left(cls, left: Column, bottom: Column, width: Column, height: Column) -> Box:
        return cls(left, bottom - height, width, height)

    def area(self) -> Column:
        return fixed.as_double(fixed.multiply(self.width, self.height))

    def shave(self, delta: Column | int, side: str | None = None) -> Box:
        """Less ``delta`` on one side, at a corner, or on all sides."""
        d = _col(delta)
        if side is None:
            return self.shave(d, "TopLeft").shave(d, "BottomRight")
        if side in CORNERS:
            upright = "Top" if side.startswith("Top") else "Bottom"
            return self.shave(d, upright).shave(d, side[len(upright) :])
        return {
            "Top": Box(self.left, self.top + d, self.width, self.height - d),
            "Bottom": Box(self.left, self.top, self.width, self.height - d),
            "Left": Box(self.left + d, self.top, self.width - d, self.height),
            "Right": Box(self.left, self.top, self.width - d, self.height),
        }[side]

    def translate(self, dx: Column | int, dy: Column | int) -> Box:
        return Box(self.left + dx, self.top + dy, self.width, self.height)

    def move_to(self, x: Column | int, y: Column | int) -> Box:
        return Box(_col(x), _col(y), self.width, self.height)

    def to_origin(self) -> Box:
        return self.move_to(0, 0)

    def scale(self, percent: float) -> Box:
        """Width and height grow by ``percent`` of themselves; the corner stays."""
        return Box(self.left, self.top, self.width + fixed.multiply(self.width, percent / 100.0), self.height + fixed.multiply(self.height, percent / 100.0))

    def split_vertical(self, x: Column | int) -> tuple[Column, Column]:
        """Structs of what is left and right of x, each null if there is nothing."""
        x = _col(x)
        some = self.left < x
        width = F.when(some, F.least(x - self.left, self.width)).otherwise(0)
        return Box(self.left, self.top, width, self.height).where(some), Box(self.left + width, self.top, self.width - width, self.height).where(x < self.right)

    def split_horizontal(self, y: Column | int) -> tuple[Column, Column]:
        y = _col(y)
        some = self.top < y
        height = F.when(some, F.least(y - self.top, self.height)).otherwise(0)
        return Box(self.left, self.top, self.width, height).where(some), Box(self.left, self.top + height, self.width, self.height - height).where(y < self.bottom)

    def horizontal_slices(self, n: int) -> Column:
        """Array of n slices of equal heights; the last has what truncation leaves."""
        each = fixed.divide(self.height, n)
        slice_ = lambda i: Box(self.left, self.top + each * i, self.width, F.when(i == n - 1, self.height - each * (n - 1)).otherwise(each)).struct()
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), slice_)

    def horizontal_slice(self, y: Column | int, height: Column | int) -> Column:
        lower = self.split_horizontal(y)[1]
        return F.when(lower.isNotNull(), Box.field(lower).split_horizontal(_col(y) + height)[0])

    def vertical_slice(self, x: Column | int, width: Column | int) -> Column:
        right = self.split_vertical(x)[1]
        return F.when(right.isNotNull(), Box.field(right).split_vertical(_col(x) + width)[0])

    def overlaps_x(self, x: Column | int) -> Column:
        return (self.left <= x) & (self.right >= x)

    def overlaps_y(self, y: Column | int) -> Column:
        return (self.top <= y) & (self.bottom >= y)

    def point(self, side: str) -> Point:
        x = self.left if side.endswith("Left") else self.right if side.endswith("Right") else self.left + fixed.divide(self.width, 2)
        y = self.top if side.startswith("Top") else self.bottom if side.startswith("Bottom") else self.top + fixed.divide(self.height, 2)
        return Point(x, y)

    def line(self, side: str) -> Line:
        ends = {"Top": ("TopLeft", "TopRight"), "Bottom": ("BottomLeft", "BottomRight"), "Left": ("TopLeft", "BottomLeft"), "Right": ("TopRight", "BottomRight")}[side]
        return Line(*self.point(ends[0]), *self.point(ends[1]))

    def fringe(self, left: int, top: int, right: int, bottom: int) -> Column:
        """Array of the left, right, top and bottom gutters of a padding."""
        inner = Box(self.left + left, self.top, self.width - (left + right), F.lit(top))
        parts = [Box(self.left, self.top, F.lit(left), self.height), Box(self.right - right, self.top, F.lit(right), self.height), inner, Box(inner.left, self.bottom - bottom, inner.width, F.lit(bottom))]
        return F.array(*[p.struct() for p in parts])

    # --- two boxes

    def union(self, other: Box) -> Box:
        return Box.edges(F.least(self.left, other.left), F.least(self.top, other.top), F.greatest(self.right, other.right), F.greatest(self.bottom, other.bottom))

    def overlap(self, other: Box) -> Box:
        """The common part's coordinates; a box only where :meth:`intersects`."""
        return Box.edges(F.greatest(self.left, other.left), F.greatest(self.top, other.top), F.least(self.right, other.right), F.least(self.bottom, other.bottom))

    def intersects(self, other: Box) -> Column:
        """Strictly: boxes that only share an edge don't."""
        o = self.overlap(other)
        return (o.width > 0) & (o.height > 0)

    def meets(self, other: Box) -> Column:
        """Closed: a shared edge or corner is enough, as in a search tree of boxes."""
        return (self.left <= other.right) & (other.left <= self.right) & (self.top <= other.bottom) & (other.top <= self.bottom)

    def intersection(self, other: Box) -> Column:
        return self.overlap(other).where(self.intersects(other))

    def overlapping_area(self, other: Box) -> Column:
        return (self.left < other.right) & (self.right > other.left) & (self.top < other.bottom) & (self.bottom > other.top)

    def overlaps(self, other: Box) -> Column:
        """The intersection has an area, at two digits."""
        return self.intersects(other) & (self.overlap(other).area() > 0)

    def touches(self, other: Box) -> Column:
        """The intersection is there but so thin that its area truncates to 0."""
        return self.intersects(other) & (self.overlap(other).area() == 0)

    def centre_distance(self, other: Box) -> Column:
        return self.point("Center").dist(other.point("Center"))

    def shares_edge(self, other: Box) -> Column:
        return (self.left == other.left) | (self.right == other.right) | (self.top == other.top) | (self.bottom == other.bottom)

    def within_v(self, other: Box) -> Column:
        return (self.left >= other.left) & (self.right <= other.right)

    def within_h(self, other: Box) -> Column:
        return (self.top >= other.top) & (self.bottom <= other.bottom)

    def within(self, other: Box) -> Column:
        return self.within_v(other) & self.within_h(other)

    def above(self, other: Box | Column | int) -> Column:
        return self.bottom < (other.top if isinstance(other, Box) else other)

    def below(self, other: Box | Column | int) -> Column:
        return self.top > (other.bottom if isinstance(other, Box) else other)

    def left_of(self, other: Box) -> Column:
        return self.right < other.left

    def right_of(self, other: Box) -> Column:
        return self.left > other.right

    def level_with(self, other: Box) -> Column:
        """Neither strictly above nor below."""
        return ~self.above(other) & ~self.below(other)

    def in_line_with(self, other: Box) -> Column:
        """Neither strictly left nor right."""
        return ~self.left_of(other) & ~self.right_of(other)

    def equals(self, other: Box) -> Column:
        return self.struct() == other.struct()

    def adjacent(self, outer: Box, side: str) -> Column:
        """The part of ``outer`` beside this box on one side or corner; "Center" is the intersection.

        Each axis is cut into what lies before, within and after this box, which is the same as
        splitting twice: a part is there if it has an extent.
        """
        if side == "Center":
            return self.intersection(outer)
        x = _parts(outer.left, outer.right, self.left, self.right)["before" if side.endswith("Left") else "after" if side.endswith("Right") else "within"]
        y = _parts(outer.top, outer.bottom, self.top, self.bottom)["before" if side.startswith("Top") else "after" if side.startswith("Bottom") else "within"]
        return F.when(x[2] & y[2], Box.edges(x[0], y[0], x[1], y[1]).struct())

    def adjacent_union(self, outer: Box, *sides: str) -> Column:
        """MBR of the adjacent parts that are there."""
        parts = F.filter(F.array(*[self.adjacent(outer, s) for s in sides]), lambda p: p.isNotNull())
        edge = lambda f, g: g(F.transform(parts, f))
        left, top = edge(lambda p: p["left"], F.array_min), edge(lambda p: p["top"], F.array_min)
        right, bottom = edge(lambda p: p["left"] + p["width"], F.array_max), edge(lambda p: p["top"] + p["height"], F.array_max)
        return F.when(F.size(parts) > 0, Box.edges(left, top, right, bottom).struct())

    def burst(self, outer: Box) -> Column:
        """The intersection, if any, then all parts beside either box within the other, by left and top."""
        beside = [self.adjacent(outer, s) for s in ADJACENT] + [outer.adjacent(self, s) for s in ADJACENT]
        parts = F.sort_array(F.filter(F.array(*beside), lambda p: p.isNotNull()))
        both = self.intersection(outer)
        return F.concat(F.when(both.isNotNull(), F.array(both)).otherwise(F.array().cast(f"array<{BOX_TYPE}>")), parts)

    # --- text

    def pretty(self) -> Column:
        return F.concat(F.lit("(l:"), fixed.show(self.left), F.lit(", t:"), fixed.show(self.top), F.lit(", w:"), fixed.show(self.width), F.lit(", h:"), fixed.show(self.height), F.lit(")"))

    def compact(self) -> Column:
        return F.concat(F.lit("["), F.concat_ws(", ", *[fixed.show(x) for x in self]), F.lit("]"))

    def uri(self) -> Column:
        return F.concat_ws("_", *[x.cast("string") for x in self])


def _parts(low: Column, high: Column, a: Column, b: Column) -> dict[str, tuple[Column, Column, Column]]:
    """Start, end and presence of the parts of [low, high] before, within and after [a, b]."""
    start = F.greatest(low, a)
    return {"before": (low, F.least(a, high), low < a), "within": (start, F.least(b, high), (a < high) & (start < b)), "after": (F.greatest(low, b), high, b < high)}


class Trapezoid(NamedTuple):
    """Two horizontal bases."""

    top_x: Column
    top_y: Column
    top_width: Column
    bottom_x: Column
    bottom_y: Column
    bottom_width: Column

    @classmethod
    def of_lines(cls, a: Line, b: Line) -> Trapezoid:
        """The line with the smaller y is the top; the first, if they are level."""
        first = a.y1 <= b.y1
        pick = lambda x, y: F.when(first, x).otherwise(y)
        sa, sb = a.sorted(), b.sorted()
        return cls(pick(sa.x1, sb.x1), pick(sa.y1, sb.y1), pick(sa.x2 - sa.x1, sb.x2 - sb.x1), pick(sb.x1, sa.x1), pick(sb.y1, sa.y1), pick(sb.x2 - sb.x1, sa.x2 - sa.x1))

    def struct(self) -> Column:
        return F.struct(*[x.alias(n) for x, n in zip(self, self._fields, strict=True)])

    def bounds(self) -> Box:
        return Box.edges(F.least(self.top_x, self.bottom_x), F.least(self.top_y, self.bottom_y), F.greatest(self.top_x + self.top_width, self.bottom_x + self.bottom_width), F.greatest(self.top_y, self.bottom_y))

    def left_angle(self) -> Column:
        return Point(self.bottom_x, self.bottom_y).angle_to(Point(self.top_x, self.top_y))

    def right_angle(self) -> Column:
        return F.lit(math.pi) - Point(self.bottom_x + self.bottom_width, self.bottom_y).angle_to(Point(self.top_x + self.top_width, self.top_y))


def angle_class(angle: Column, tolerance: float = RIGHT_ANGLE_TOLERANCE) -> Column:
    """Right within the tolerance of a right angle, else Acute or Obtuse."""
    half = math.pi / 2
    return F.when(angle.between(half - tolerance, half + tolerance), "Right").when(angle < half, "Acute").otherwise("Obtuse")


def angle_filter(angle: Column, low: float, high: float) -> Column:
    """Whether an angle, folded to [-pi/2, pi/2), is in [low, high), wrapping round if low > high."""
    fold = lambda a: a - math.pi * math.floor((a + math.pi / 2) / math.pi)
    x = angle - F.lit(math.pi) * F.floor((angle + math.pi / 2) / math.pi)
    low, high = fold(low), fold(high)
    return (x >= low) & (x < high) if low <= high else (x >= low) | (x < high)


def figure_bounds(kind: Column, box: Box, low_left: Box, point: Point, line: Line, trapezoid: Trapezoid) -> Column:
    """MBR of a figure by its kind (``box``, ``low_left``, ``point``, ``line``, ``trapezoid``); another kind is an error."""
    zero = F.lit(0)
    return (
        F.when(kind == "box", box.struct())
        .when(kind == "low_left", Box.from_low_left(*low_left).struct())
        .when(kind == "point", Box(point.x, point.y, zero, zero).struct())
        .when(kind == "line", line.bounds().struct())
        .when(kind == "trapezoid", trapezoid.bounds().struct())
        .otherwise(F.raise_error(F.concat(F.lit("no bounds for figure "), kind)))
    )


# --- paths of points --------------------------------------------------------------------


def unique_points(points: Column) -> Column:
    return F.array_distinct(points)


def segments(points: Column) -> Column:
    """Segments between following points, and the one that closes the path."""
    n = F.size(points)
    pair = lambda i: F.struct(F.element_at(points, i).alias("p1"), F.element_at(points, F.when(i == n, 1).otherwise(i + 1)).alias("p2"))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n), pair)).otherwise(F.array().cast("array<struct<p1:struct<x:int,y:int>,p2:struct<x:int,y:int>>>"))


def orientation(segment: Column) -> Column:
    """V, H, Slanted, or Empty for a segment of one point."""
    same_x, same_y = segment["p1"]["x"] == segment["p2"]["x"], segment["p1"]["y"] == segment["p2"]["y"]
    return F.when(same_x & same_y, "Empty").when(same_x, "V").when(same_y, "H").otherwise("Slanted")


# --- graph paper ------------------------------------------------------------------------


class GridBox(NamedTuple):
    """A box of whole cells: origin and how many cells it spans beyond it."""

    x: Column
    y: Column
    right: Column
    down: Column

    def extend(self, right: Column | int = 0, down: Column | int = 0) -> GridBox:
        return GridBox(self.x, self.y, self.right + right, self.down + down)

    def with_width(self, cells: Column | int) -> GridBox:
        return GridBox(self.x, self.y, _col(cells) - 1, self.down)

    def translate(self, dx: Column | int, dy: Column | int) -> GridBox:
        return GridBox(self.x + dx, self.y + dy, self.right, self.down)

    def union(self, other: GridBox) -> GridBox:
        x, y = F.least(self.x, other.x), F.least(self.y, other.y)
        return GridBox(x, y, F.greatest(self.x + self.right, other.x + other.right) - x, F.greatest(self.y + self.down, other.y + other.down) - y)

    def cells(self) -> Column:
        """All cells, row by row."""
        rows = F.sequence(self.y, self.y + self.down)
        return F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(self.x, self.x + self.right), lambda c: F.struct(c.alias("x"), r.alias("y")))))

    def box(self, cell_width: int, cell_height: int) -> Box:
        return Box(self.x * cell_width, self.y * cell_height, (self.right + 1) * cell_width, (self.down + 1) * cell_height)


def matrix_cell(box: Box) -> Point:
    """The cell of 10 x 10 units that a box's corner is in."""
    return Point(F.floor(box.left / 1000).cast("int"), F.floor(box.top / 1000).cast("int"))


def cell_box(x: Column, y: Column) -> Box:
    """A cell's 10 x 10 units, shaved by a tenth on all sides."""
    return Box(x * 1000, y * 1000, F.lit(1000), F.lit(1000)).shave(10)


# --- colours ----------------------------------------------------------------------------


def hex_of_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("int")), 2, "0") for c in (r, g, b)]))


def rgb_of_hex(text: Column) -> Column:
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def grey_of_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.round(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def cmyk_of_rgb(r: Column, g: Column, b: Column) -> Column:
    k = 1 - F.greatest(r, g, b) / 255.0
    part = lambda c: F.when(k == 1, 0.0).otherwise((1 - c / 255.0 - k) / (1 - k))
    return F.struct(part(r).alias("c"), part(g).alias("m"), part(b).alias("y"), k.alias("k"))


def hsv_of_rgb(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    d = high - low
    hue = F.when(d == 0, 0.0).when(high == r / 255.0, (g - b) / 255.0 / d % 6).when(high == g / 255.0, (b - r) / 255.0 / d + 2).otherwise((r - g) / 255.0 / d + 4)
    hue = F.when(hue < 0, hue + 6).otherwise(hue) * 60
    return F.struct(hue.alias("h"), F.when(high == 0, 0.0).otherwise(d / high).alias("s"), high.alias("v"))


def hsl_of_rgb(r: Column, g: Column, b: Column) -> Column:
    high, low = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    light = (high + low) / 2
    return F.struct(hsv_of_rgb(r, g, b)["h"].alias("h"), F.when(high == low, 0.0).otherwise((high - low) / (1 - F.abs(2 * light - 1))).alias("s"), light.alias("l"))
