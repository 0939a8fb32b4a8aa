"""What users add: statistics, potentials, table fitters and radial bases.

Each kind has a registry by name. A statistic is mapped over batches of rows to
partial rows, which Spark merges by key; a fitter sees the rows of one table; a
basis turns a batch of coordinates into arrays.
"""

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from mesospark.functions.potentials import Potential
from mesospark.functions.splines import basis_array, clamped_knots, periodic_basis

#: How partial columns merge.
MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Statistic:
    """``needs``: columns that are read. ``partial``: a batch (with its keys) to one row a key. ``merge``: partial column -> sum, min or max. ``final``: result column -> SQL over the merged columns."""

    needs: tuple[str, ...]
    partial: Callable[[pd.DataFrame], pd.DataFrame]
    merge: dict[str, str]
    final: dict[str, str]


@dataclass(frozen=True)
class Fitter:
    """``fit``: the rows of one table, in order of x, to a frame of ``schema`` (without the key)."""

    fit: Callable[..., pd.DataFrame]
    schema: str
    least_rows: int = 1


@dataclass
class Registry:
    kind: str
    held: dict = field(default_factory=dict)

    def add(self, name: str, value) -> None:
        if name in self.held:
            raise ValueError(f"there is a {self.kind} named {name}")
        self.held[name] = value

    def __getitem__(self, name: str):
        if name not in self.held:
            raise KeyError(f"no {self.kind} named {name}; there are {sorted(self.held)}")
        return self.held[name]


STATISTICS, POTENTIALS, FITTERS, BASES = Registry("statistic"), Registry("potential"), Registry("fitter"), Registry("basis")


def run_statistic(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys with the final columns of a statistic; partial rows are made in tasks and merged by key."""
    s: Statistic = STATISTICS[name]
    source = rows.select(*keys, *s.needs)
    types = dict(source.dtypes)

    def partial(frames):
        for f in frames:
            if len(f):
                yield s.partial(f)[[*keys, *s.merge]]

    made = source.mapInPandas(partial, ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{c}` double" for c in s.merge)]))
    merged = made.groupBy(*keys).agg(*[MERGES[how](c).alias(c) for c, how in s.merge.items()])
    return merged.select(*keys, *[F.expr(e).alias(c) for c, e in s.final.items()])


def fit_tables(tables: DataFrame, name: str, **options) -> DataFrame:
    """``key`` and the columns of a fitter, one table (``key, x, ...``) at a time; a table with too few rows is an error."""
    fitter: Fitter = FITTERS[name]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) < fitter.least_rows:
            raise ValueError(f"table {f.key.iloc[0]} has {len(f)} rows; {name} needs {fitter.least_rows}")
        out = fitter.fit(f.sort_values("x", ignore_index=True), **options)
        return out.assign(key=f.key.iloc[0])

    return tables.groupBy("key").applyInPandas(run, f"key string, {fitter.schema}").select("key", *[c.split()[0] for c in fitter.schema.split(", ")])


@dataclass(frozen=True)
class Basis:
    """``evaluate(x, n)`` and ``derivative(x, n)``: a batch of coordinates to rows x functions."""

    evaluate: Callable[[np.ndarray, int], np.ndarray]
    derivative: Callable[[np.ndarray, int], np.ndarray] | None = None


def basis_values(x: Column, name: str, n: int, *, derivative: bool = False) -> Column:
    """``array<double>`` of the n functions of a registered basis at x, or of their derivatives."""
    held = BASES[name]
    held = held if isinstance(held, Basis) else Basis(held)
    evaluate = held.derivative if derivative else held.evaluate
    if evaluate is None:
        raise ValueError(f"basis {name} has no derivative")

    @pandas_udf("array<double>")
    def values(s: pd.Series) -> pd.Series:
        return pd.Series(list(evaluate(s.to_numpy(float), n)))

    return values(x)


def least_squares(design: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-9) -> np.ndarray:
    w = np.ones(len(y)) if weight is None else weight
    gram = design.T @ (design * w[:, None])
    return np.linalg.solve(gram + ridge * np.eye(len(gram)), design.T @ (w * y))


def bounded_least_squares(design: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, passes: int = 5000) -> np.ndarray:
    """Least squares within bounds, one coefficient after the other until none moves."""
    gram, right, c = design.T @ design, design.T @ y, np.clip(np.zeros(design.shape[1]), low, high)
    for _ in range(passes):
        moved = 0.0
        for k in range(len(c)):
            new = np.clip(c[k] + (right[k] - gram[k] @ c) / max(gram[k, k], 1e-300), low[k], high[k])
            moved, c[k] = max(moved, abs(new - c[k])), new
        if moved < 1e-13:
            break
    return c


def _numbered(c: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"p": np.arange(len(c)), "c": c})


def _spline(f: pd.DataFrame, n: int = 6, degree: int = 3) -> pd.DataFrame:
    """Clamped spline of the force; rows may have a weight."""
    knots = clamped_knots(f.x.min(), f.x.max(), n, degree)
    return _numbered(least_squares(basis_array(f.x.to_numpy(), knots, degree), f.f.to_numpy(), f.weight.to_numpy(float) if "weight" in f else None))


def _dihedral(f: pd.DataFrame, n: int = 8) -> pd.DataFrame:
    """Periodic spline of the force with a zero integral over the period; coefficients sum to zero."""
    x = f.x.to_numpy()
    c = least_squares(np.stack([periodic_basis(x, k, n, np.where) for k in range(n)], 1), f.f.to_numpy())
    return _numbered(c - c.mean())  # equal coefficients add nothing


def _gaussians(f: pd.DataFrame, n: int = 5, anchor: float = 10.0) -> pd.DataFrame:
    """Amplitudes of Gaussians with centres on a uniform grid and a width of one step.

    The first is repulsive (not negative), the others attract (not positive); the
    last point of the table is an anchor of the given weight.
    """
    x, v = f.x.to_numpy(), f.v.to_numpy()
    centres, width = np.linspace(x.min(), x.max(), n), (x.max() - x.min()) / (n - 1)
    design = np.exp(-((x[:, None] - centres) ** 2) / (2 * width**2))
    weight = np.where(np.arange(len(x)) == len(x) - 1, anchor, 1.0) ** 0.5
    low, high = np.r_[0.0, np.full(n - 1, -np.inf)], np.r_[np.inf, np.zeros(n - 1)]
    return _numbered(bounded_least_squares(design * weight[:, None], v * weight, low, high)).assign(centre=centres, width=width)


def _line(f: pd.DataFrame) -> pd.DataFrame:
    slope, at = np.polyfit(f.x.to_numpy(), f.f.to_numpy(), 1)
    return pd.DataFrame({"slope": [slope], "at_zero": [at]})


FITTERS.add("spline", Fitter(_spline, "p int, c double", 2))
FITTERS.add("dihedral", Fitter(_dihedral, "p int, c double", 8))
FITTERS.add("gaussians", Fitter(_gaussians, "p int, c double, centre double, width double", 5))
FITTERS.add("line", Fitter(_line, "slope double, at_zero double", 2))


def _power_sums(f: pd.DataFrame) -> pd.DataFrame:
    made = pd.DataFrame({"key": f.key, "s0": f.w, "s1": f.w * f.value, "s2": f.w * f.value**2, "s3": f.w * f.value**3})
    return made.groupby("key", as_index=False).sum()


STATISTICS.add("third_moment", Statistic(("value", "w"), _power_sums, {f"s{k}": "sum" for k in range(4)}, {"mean": "s1 / s0", "third": "s3 / s0 - 3 * s1 / s0 * s2 / s0 + 2 * power(s1 / s0, 3)"}))

POTENTIALS.add("morse", Potential(
    ("d", "a", "r0"),
    lambda r, d, a, r0: d * (1 - F.exp(-a * (r - r0))) * (1 - F.exp(-a * (r - r0))),
    lambda r, d, a, r0: -2 * d * a * (1 - F.exp(-a * (r - r0))) * F.exp(-a * (r - r0)),
    lambda r, d, a, r0: {
        "d": (1 - F.exp(-a * (r - r0))) * (1 - F.exp(-a * (r - r0))),
        "a": 2 * d * (1 - F.exp(-a * (r - r0))) * F.exp(-a * (r - r0)) * (r - r0),
        "r0": -2 * d * a * (1 - F.exp(-a * (r - r0))) * F.exp(-a * (r - r0)),
    },
    bounds={"d": (0.0, None), "a": (0.0, 3.0), "r0": (0.5, 2.0)},
    frozen=("r0",),
))


def _chebyshev_slope(x: np.ndarray, n: int) -> np.ndarray:
    t, k = x[:, None] - 1, np.arange(n)
    theta = np.arccos(np.clip(t, -1, 1))
    inner = k * np.sin(k * theta) / np.where(np.abs(t) < 1, np.sin(theta), 1.0)
    return np.where(np.abs(t) < 1, inner, np.where(np.abs(t) == 1, k * k * np.where(t < 0, -1.0, 1.0) ** (k + 1), 0.0))


#: Chebyshev polynomials of the first kind on coordinates in [0, 2], constant beyond.
BASES.add("chebyshev", Basis(lambda x, n: np.cos(np.arange(n) * np.arccos(np.clip(x[:, None] - 1, -1, 1))), _chebyshev_slope))
