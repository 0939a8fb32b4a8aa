"""Fits of one table within bounds and with anchors near its cutoff, as fitters by name.

``bounded_spline`` and ``anchored_gaussians`` add rows to the design that ask for a
value of 0 and a slope of 0 at points up to the cutoff; ``compact_dihedral`` fits
a force that ends inside the period and has no integral. A table is small, so
one fit is one matrix in one task; tables are fitted in parallel.
"""

import numpy as np
import pandas as pd

from mesospark.functions.splines import basis_array, basis_slope_array, clamped_knots, compact_knots
from mesospark.operators.extensions import FITTERS, Fitter, least_squares


def bounded_fit(design: np.ndarray, y: np.ndarray, low, high) -> np.ndarray:
    """Least squares within bounds (numbers or one for each coefficient, also infinite), by active sets.

    Coefficients at a bound are freed while the sum of squares falls; those that leave
    their bounds stop there. Lower bounds above upper ones are an error.
    """
    k = design.shape[1]
    low, high = np.broadcast_to(np.asarray(low, float), k), np.broadcast_to(np.asarray(high, float), k)
    if (low > high).any():
        raise ValueError("a lower bound is above its upper bound")
    c = np.clip(np.zeros(k), low, high)
    free, freed = (c > low) & (c < high), -1
    small = 1e-11 * max(np.abs(design).max(initial=0.0) * np.abs(y).max(initial=0.0) * len(y), 1e-300)
    barred: set[int] = set()
    for _ in range(50 * k + 50):
        while free.any():
            best = c.copy()
            best[free] = np.linalg.lstsq(design[:, free], y - design[:, ~free] @ c[~free], rcond=None)[0]
            out = free & ((best < low) | (best > high))
            if not out.any():
                c = best
                break
            edge = np.where(best < low, low, high)
            share = np.where(out, (edge - c) / np.where(out, best - c, 1.0), np.inf)
            stops = int(np.argmin(share))
            c = np.clip(c + max(share[stops], 0.0) * (best - c), low, high)
            c[stops], free[stops] = edge[stops], False
            if share[stops] > 0:
                barred.clear()
            elif stops == freed:
                barred.add(stops)  # freed in vain: not again before something moves
        pull = design.T @ (y - design @ c)
        gain = np.where(~free & (low < high) & (((c <= low) & (pull > small)) | ((c >= high) & (pull < -small))), np.abs(pull), 0.0)
        gain[list(barred)] = 0.0
        if not gain.any():
            return c
        freed = int(np.argmax(gain))
        free[freed] = True
    raise RuntimeError("bounded least squares did not settle")


def anchor_points(x: np.ndarray, cutoff: float | None, n: int, span: float) -> np.ndarray:
    """``n`` points over ``span`` up to the cutoff, which is held inside the table; none for n = 0."""
    end = x.max() if cutoff is None else min(cutoff, x.max())
    start = max(end - span, x.min())
    return np.linspace(start, end, n) if n > 1 and start < end else np.full(min(n, 1), float(end))


def _checked(f: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    x, y = f.x.to_numpy(float), f[column].to_numpy(float)
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError(f"table {f.key.iloc[0]} has values that are not finite")
    if (np.diff(x) <= 0).any():
        raise ValueError(f"table {f.key.iloc[0]} repeats a coordinate")
    return x, y


def _anchored(data, value, slope, y, weights, row_weight):
    """Design and right side with the rows of the anchors below those of the table."""
    w = [weights[0] * np.sqrt(row_weight), np.full(len(value), weights[1]), np.full(len(slope), weights[2])]
    design = np.concatenate([m * u[:, None] for m, u in zip((data, value, slope), w, strict=True)])
    return design, np.concatenate([y * w[0], np.zeros(len(value) + len(slope))])


def _row_weight(f: pd.DataFrame) -> np.ndarray:
    return f.weight.to_numpy(float) if "weight" in f else np.ones(len(f))


def _bounded_spline(f: pd.DataFrame, n: int = 8, degree: int = 3, low=-np.inf, high=np.inf, anchors: int = 3, span: float = 0.1, weights=(1.0, 10.0, 10.0)) -> pd.DataFrame:
    """Clamped spline of the force (of the energy's slope where there is no ``f``); ``weights`` of rows, anchored values and slopes."""
    if "f" not in f:
        f = f.assign(f=-np.gradient(f.v.to_numpy(float), f.x.to_numpy(float)))
    x, y = _checked(f, "f")
    knots, at = clamped_knots(float(x[0]), float(x[-1]), n, degree), anchor_points(x, None, anchors, span)
    design, right = _anchored(basis_array(x, knots, degree), basis_array(at, knots, degree), basis_slope_array(at, knots, degree), y, weights, _row_weight(f))
    return pd.DataFrame({"p": np.arange(n), "c": bounded_fit(design, right, low, high)})


def gaussian_array(x: np.ndarray, centres: np.ndarray, width: float, order: int = 0) -> np.ndarray:
    """Rows x Gaussians of height 1, or their derivatives."""
    d = (x[:, None] - centres) / width
    g = np.exp(-d * d / 2)
    return -d / width * g if order else g


def _anchored_gaussians(
    f: pd.DataFrame, n: int = 5, cutoff: float | None = None, anchors: int = 3, span: float = 0.2, weights=(1.0, 10.0, 10.0), margins=(0.0, 0.15, 0.3), widths=(0.5, 1.0, 2.0, 3.0), repulsive: int | None = 0, low: float = -np.inf, high: float = np.inf
) -> pd.DataFrame:
    """Amplitudes of Gaussians with centres and one width taken from a grid of starts, the one with the least sum of squares.

    Centres are even between the ends of the table, ``margins`` of its range away from
    them; ``widths`` are multiples of range / 2n. Component number ``repulsive`` is not
    negative and the others not positive (None: bounds alone).
    """
    x, v = _checked(f, "v")
    reach, at = (x[-1] - x[0]) or 1.0, anchor_points(x, cutoff, anchors, span)
    lowest, highest = np.full(n, float(low)), np.full(n, float(high))
    if repulsive is not None:
        lowest[repulsive] = max(low, 0.0)
        highest[np.arange(n) != repulsive] = min(high, 0.0)
    best = None
    for margin in margins:
        centres = np.linspace(x[0] + margin * reach, x[-1] - margin * reach, n)
        for times in widths:
            width = max(times * reach / (2 * n), 1e-6)
            design, right = _anchored(gaussian_array(x, centres, width), gaussian_array(at, centres, width), gaussian_array(at, centres, width, 1), v, weights, _row_weight(f))
            c = bounded_fit(design, right, lowest, highest)
            left = float(((design @ c - right) ** 2).sum())
            if best is None or left < best[0]:
                best = left, c, centres, width
    left, c, centres, width = best
    return pd.DataFrame({"p": np.arange(n), "c": c, "centre": centres, "width": width, "objective": left})


def _compact_dihedral(f: pd.DataFrame, n: int = 6, lo: float = -150.0, hi: float = 150.0, degree: int = 3) -> pd.DataFrame:
    """Force on degrees that is zero with its slope at lo and hi and beyond, and whose integral is zero; rows beyond are not read."""
    x, y = _checked(f, "f")
    inside = (x >= lo) & (x <= hi)
    if inside.sum() < n:
        raise ValueError(f"table {f.key.iloc[0]} has {inside.sum()} rows from {lo} to {hi}; {n} coefficients need as many")
    raw = basis_array(x[inside], compact_knots(lo, hi, n, degree), degree)
    c = least_squares(raw[:, :-1] - raw[:, -1:], y[inside], _row_weight(f)[inside], ridge=1e-12)
    return pd.DataFrame({"p": np.arange(n), "c": c})


FITTERS.add("bounded_spline", Fitter(_bounded_spline, "p int, c double", 4))
FITTERS.add("anchored_gaussians", Fitter(_anchored_gaussians, "p int, c double, centre double, width double, objective double", 5))
FITTERS.add("compact_dihedral", Fitter(_compact_dihedral, "p int, c double", 6))
