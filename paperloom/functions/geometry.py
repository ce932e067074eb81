"""Affine matrices (a, b, c, d, e, f), points and rectangles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = tuple  # of six columns or numbers


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def multiply(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    a, b, c, d, e, f = map(_c, m)
    g, h, i, j, k, l = map(_c, n)  # noqa: E741
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l


def inverse(m: Matrix) -> Matrix:
    """The inverse; null entries where there is none."""
    a, b, c, d, e, f = map(_c, m)
    det = a * d - b * c
    q = lambda x: F.when(det != 0, x / F.when(det == 0, F.lit(1.0)).otherwise(det))
    return q(d), q(-b), q(-c), q(a), q(c * f - d * e), q(b * e - a * f)


def apply(m: Matrix, x, y) -> tuple[Column, Column]:
    a, b, c, d, e, f = map(_c, m)
    x, y = _c(x), _c(y)
    return a * x + c * y + e, b * x + d * y + f


def rotation(degrees) -> Matrix:
    t = F.radians(_c(degrees))
    return F.cos(t), F.sin(t), -F.sin(t), F.cos(t), 0.0, 0.0


def skew(x_degrees, y_degrees) -> Matrix:
    return 1.0, F.tan(F.radians(_c(x_degrees))), F.tan(F.radians(_c(y_degrees))), 1.0, 0.0, 0.0


def apply_box(m: Matrix, llx, lly, urx, ury) -> tuple[Column, Column, Column, Column]:
    """The box around the four moved corners."""
    corners = [apply(m, x, y) for x in (llx, urx) for y in (lly, ury)]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def contains(box: tuple, x, y) -> Column:
    llx, lly, urx, ury = map(_c, box)
    return _c(x).between(llx, urx) & _c(y).between(lly, ury)


def intersects(p: tuple, q: tuple) -> Column:
    a, b = list(map(_c, p)), list(map(_c, q))
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(_c(x1) - _c(x2), F.lit(2.0)) + F.pow(_c(y1) - _c(y2), F.lit(2.0)))
