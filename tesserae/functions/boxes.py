"""Box arithmetic as column expressions. Boxes are xywh unless a name says otherwise; a quotient of nothing is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(p: str, n: str) -> Column:
    return F.col(f"{p}{n}")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def once(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def overlap(p: str, q: str) -> Column:
    """Area that boxes of column prefixes p and q share."""
    w = F.least(_c(p, "x") + _c(p, "w"), _c(q, "x") + _c(q, "w")) - F.greatest(_c(p, "x"), _c(q, "x"))
    h = F.least(_c(p, "y") + _c(p, "h"), _c(q, "y") + _c(q, "h")) - F.greatest(_c(p, "y"), _c(q, "y"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def area(p: str) -> Column:
    return _c(p, "w") * _c(p, "h")


def union(p: str, q: str) -> Column:
    return area(p) + area(q) - overlap(p, q)


def iou(p: str, q: str) -> Column:
    return ratio(overlap(p, q), union(p, q))


def ioa(p: str, q: str) -> Column:
    """Of the area of q."""
    return ratio(overlap(p, q), area(q))


def iom(p: str, q: str) -> Column:
    """Of the smaller area."""
    return ratio(overlap(p, q), F.least(area(p), area(q)))


def giou(p: str, q: str) -> Column:
    hull = (F.greatest(_c(p, "x") + _c(p, "w"), _c(q, "x") + _c(q, "w")) - F.least(_c(p, "x"), _c(q, "x"))) * (F.greatest(_c(p, "y") + _c(p, "h"), _c(q, "y") + _c(q, "h")) - F.least(_c(p, "y"), _c(q, "y")))
    return iou(p, q) - ratio(hull - union(p, q), hull)


def strictly_inside(centre: Column, margin: float) -> Column:
    """A centre, as a share of the image, that is off the border by more than the margin."""
    return (centre > margin) & (centre < 1 - margin)


def enlarged(x: Column, y: Column, w: Column, h: Column, padding: float, width: int, height: int) -> list[Column]:
    """A box grown by 1 / (1 - padding), centred on itself and shifted into the image: (x, y, w, h). Its size is truncated, not clamped."""
    nw, nh = (w / (1 - padding)).cast("long"), (h / (1 - padding)).cast("long")
    nx = (x + w / 2 - nw / 2).cast("long")
    ny = (y + h / 2 - nh / 2).cast("long")
    shift = lambda v, n, most: F.greatest(F.lit(0), F.least(v, F.lit(most) - n))
    return [shift(nx, nw, width), shift(ny, nh, height), nw, nh]


def shoelace(points: Column) -> Column:
    """Area of a polygon of [x1, y1, x2, y2, ...]."""
    n = (F.size(points) / 2).cast("int")
    at = lambda i: (F.get(points, (2 * (i % n)).cast("int")), F.get(points, (2 * (i % n) + 1).cast("int")))

    def cross(i):
        (x, y), (u, v) = at(i), at(i + 1)
        return x * v - u * y

    terms = F.transform(F.sequence(F.lit(0), n - 1), cross)
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def suppressed(items: Column, threshold: float, inclusive: bool, by: str = "iou") -> Column:
    """Greedy suppression as a fold: of items (structs in score order with x, y, w, h) those that no kept one overlaps too much.

    An overlap equal to the threshold suppresses only if ``inclusive``. An item that is itself suppressed suppresses none.
    """

    def measure(a, b):
        w = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
        h = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
        shared, aa, bb = w * h, a["w"] * a["h"], b["w"] * b["h"]
        return ratio(shared, F.least(aa, bb) if by == "iom" else aa + bb - shared)

    def hit(k, e):
        m = measure(k, e)
        return m >= threshold if inclusive else m > threshold

    return F.aggregate(F.slice(items, 2, 1 << 30), F.slice(items, 1, 1), lambda kept, e: F.when(F.exists(kept, lambda k: hit(k, e)), kept).otherwise(F.concat(kept, F.array(e))))


# Rotated boxes: centre, size, angle in degrees.
def wrapped_angle(a: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def upright_bounds(cx: Column, cy: Column, w: Column, h: Column, a: Column) -> list[Column]:
    """The smallest upright box around a rotated one: (x1, y1, x2, y2)."""
    c, s = F.abs(F.cos(F.radians(a))), F.abs(F.sin(F.radians(a)))
    nw, nh = c * w + s * h, c * h + s * w
    return [cx - nw / 2, cy - nh / 2, cx + nw / 2, cy + nh / 2]


def clipped_if_level(cx: Column, cy: Column, w: Column, h: Column, a: Column, width: int, height: int, tolerance: float = 1.0) -> list[Column]:
    """(cx, cy, w, h) cut to the image if the box is level within the tolerance, else as it was; sizes never grow."""
    level = F.abs(wrapped_angle(a)) <= tolerance
    cut = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))
    out = []
    for c, n, most in ((cx, w, width), (cy, h, height)):
        lo, hi = cut(c - n / 2, most), cut(c + n / 2, most)
        out.append((F.when(level, (lo + hi) / 2).otherwise(c), F.when(level, F.least(n, hi - lo)).otherwise(n)))
    return [out[0][0], out[1][0], out[0][1], out[1][1]]


def corners(cx: Column, cy: Column, w: Column, h: Column, a: Column) -> Column:
    """Of a rotated box, as an array of (x, y) in one sense of rotation."""
    c, s = F.cos(F.radians(a)), F.sin(F.radians(a))
    at = lambda i, j: F.struct((cx + i * w / 2 * c + j * h / 2 * s).alias("x"), (cy - i * w / 2 * s + j * h / 2 * c).alias("y"))
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def convex_overlap(p: Column, q: Column) -> Column:
    """Area that two convex polygons of (x, y) in the same sense share: p cut by each side of q in turn, as a fold."""
    none = F.array().cast("array<struct<x:double,y:double>>")
    sides = F.transform(q, lambda b, i: F.struct(F.element_at(q, F.when(i == 0, F.size(q)).otherwise(i).cast("int")).alias("a"), b.alias("b")))

    def cut(poly, e):
        a, b = e["a"], e["b"]
        side = lambda v: (b["x"] - a["x"]) * (v["y"] - a["y"]) - (b["y"] - a["y"]) * (v["x"] - a["x"])

        def kept(v, i):
            u = F.element_at(poly, F.when(i == 0, F.size(poly)).otherwise(i).cast("int"))

            def corner(e):
                u, sv, su = e["u"], e["sv"], e["su"]
                t = su / (su - sv)
                cross = F.struct((u["x"] + (v["x"] - u["x"]) * t).alias("x"), (u["y"] + (v["y"] - u["y"]) * t).alias("y"))
                return F.when((sv >= 0) & (su >= 0), F.array(v)).when(sv >= 0, F.array(cross, v)).when(su >= 0, F.array(cross)).otherwise(none)

            return once(F.struct(u.alias("u"), side(v).alias("sv"), side(u).alias("su")), corner)

        return F.flatten(F.transform(poly, kept))

    left = F.aggregate(sides, p, cut)
    flat = F.flatten(F.transform(left, lambda v: F.array(v["x"], v["y"])))
    return once(flat, lambda f: F.when(F.size(f) >= 6, shoelace(f)).otherwise(0.0))


def zoomed(x: Column, y: Column, w: Column, h: Column, width: float, height: float, area: Column, share: float) -> tuple[Column, Column, Column, Column]:
    """x, y, w, h of a crop around a box: a fifth wider and higher, 16 at least; larger yet, by the root of the excess, if the mask would fill over ``share`` of it. Shifted into the image."""
    grown = lambda n, most: F.least(n + F.greatest(0.2 * n, F.lit(16.0)), F.lit(float(most)))
    gw, gh = grown(w, width), grown(h, height)
    excess = F.greatest(F.lit(1.0), F.sqrt(area / (gw * gh) / F.lit(share)))
    nw, nh = F.least(gw * excess, F.lit(float(width))), F.least(gh * excess, F.lit(float(height)))

    def start(at, size, new, most):
        shift = (new - size) / 2
        return at - F.least(at.cast("double"), F.when(at - shift + new > most, at + new - most).otherwise(shift))

    return start(x, w, nw, width), start(y, h, nh, height), nw, nh
