"""B-splines of any degree, as column functions and over numpy arrays.

Bases are numbered from 0. Clamped splines are zero outside their knots; the
last interval is closed. Coefficients are numbers, so sums over bases fold into
one expression inside generated code.
"""

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped_knots(lo: float, hi: float, n: int, degree: int) -> list[float]:
    """Uniform knots on [lo, hi] for ``n`` bases, the ends repeated ``degree + 1`` times."""
    if n <= degree:
        raise ValueError(f"degree {degree} needs more than {degree} bases, not {n}")
    inner = n - degree
    return [lo] * degree + [lo + (hi - lo) * k / inner for k in range(inner + 1)] + [hi] * degree


def _column_inside(x: Column, a: float, b: float, closed: bool) -> Column:
    return F.when((x >= a) & ((x <= b) if closed else (x < b)), 1.0).otherwise(0.0)


def _array_inside(x: np.ndarray, a: float, b: float, closed: bool) -> np.ndarray:
    return ((x >= a) & ((x <= b) if closed else (x < b))).astype(float)


def _recursion(x, knots: Sequence[float], i: int, degree: int, inside: Callable):
    """Cox-de Boor; None where the basis is zero everywhere."""
    if not degree:
        last = max(k for k in range(len(knots) - 1) if knots[k] < knots[k + 1])
        return inside(x, knots[i], knots[i + 1], i == last) if knots[i] < knots[i + 1] else None
    out = None
    for low, high, base in ((knots[i], knots[i + degree], i), (knots[i + degree + 1], knots[i + 1], i + 1)):
        below = _recursion(x, knots, base, degree - 1, inside) if low != high else None
        if below is not None:
            term = (x - low) / (high - low) * below
            out = term if out is None else out + term
    return out


def basis(x: Column, knots: Sequence[float], i: int, degree: int) -> Column:
    """Clamped basis number i at x."""
    found = _recursion(x, knots, i, degree, _column_inside)
    return F.lit(0.0) if found is None else found


def basis_array(x: np.ndarray, knots: Sequence[float], degree: int) -> np.ndarray:
    """Rows x bases."""
    columns = [_recursion(x, knots, i, degree, _array_inside) for i in range(len(knots) - degree - 1)]
    return np.stack([np.zeros(len(x)) if c is None else c for c in columns], 1)


def basis_slope_array(x: np.ndarray, knots: Sequence[float], degree: int) -> np.ndarray:
    """Rows x derivatives of the bases."""
    below = basis_array(x, knots, degree - 1)
    over = [degree / (knots[i + degree] - knots[i]) if knots[i] < knots[i + degree] else 0.0 for i in range(below.shape[1])]
    return below[:, :-1] * over[:-1] - below[:, 1:] * over[1:]


def spline(x: Column, knots: Sequence[float], coefficients: Sequence[float], degree: int) -> Column:
    """Sum of the bases times their coefficients."""
    return sum((c * basis(x, knots, i, degree) for i, c in enumerate(coefficients) if c), F.lit(0.0))


def spline_slope(x: Column, knots: Sequence[float], coefficients: Sequence[float], degree: int) -> Column:
    """Derivative of the spline: a spline of one degree less over the inner knots."""
    steps = [degree * (b - a) / (knots[i + degree + 1] - knots[i + 1]) for i, (a, b) in enumerate(zip(coefficients, coefficients[1:], strict=False))]
    return spline(x, knots[1:-1], steps, degree - 1)


def spline_rest(x: Column, knots: Sequence[float], coefficients: Sequence[float], degree: int) -> Column:
    """Integral of the spline from x to the last knot: the energy of a force that ends there (x is held inside the knots)."""
    wider, total = [knots[0], *knots, knots[-1]], [0.0]
    for i, c in enumerate(coefficients):
        total.append(total[-1] + c * (knots[i + degree + 1] - knots[i]) / (degree + 1))
    held = F.greatest(F.lit(float(knots[0])), F.least(F.lit(float(knots[-1])), x))
    return total[-1] - spline(held, wider, total, degree + 1)


def compact_knots(lo: float, hi: float, n: int, degree: int) -> list[float]:
    """Even knots of the n + 1 bases behind ``n`` coefficients of a dihedral force that ends smoothly at lo and hi.

    The last basis takes the negative sum of the coefficients (``compact_coefficients``),
    so the integral is zero; ``spline`` and ``spline_rest`` then are force and energy.
    """
    if degree < 2:
        raise ValueError("a force that ends smoothly needs degree 2 at least")
    if not -180 <= lo < hi <= 180 or hi - lo >= 360:
        raise ValueError(f"the range from {lo} to {hi} is not narrower than a period")
    parts = n + 1 + degree
    return [lo + (hi - lo) * k / parts for k in range(parts)] + [hi]


def compact_coefficients(coefficients: Sequence[float]) -> list[float]:
    return [*coefficients, -sum(coefficients)]


def periodic_basis(x, k: int, n: int, where=None):
    """Cubic basis number k of n on degrees, folded into one period, less its mean, so that its integral is zero.

    ``x`` is a column, or an array with ``where=np.where``.
    """
    if n < 5:
        raise ValueError("a periodic cubic spline needs five bases")
    step = 360.0 / n
    floor, absolute = (F.floor, F.abs) if where is None else (np.floor, np.abs)
    u = absolute(_offset(x, k, n, step, floor))
    near, far = 2.0 / 3.0 - u * u + u * u * u / 2, (2.0 - u) * (2.0 - u) * (2.0 - u) / 6
    if where is None:
        return F.when(u < 1, near).when(u < 2, far).otherwise(0.0) - 1.0 / n
    return where(u < 1, near, where(u < 2, far, 0.0)) - 1.0 / n


def _offset(x, k: int, n: int, step: float, floor):
    """Steps from the basis's centre, in [-n/2, n/2)."""
    t = (x + 180.0) / step - k
    return t - n * floor(t / n + 0.5)
