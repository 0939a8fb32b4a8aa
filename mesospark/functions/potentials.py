"""Potentials as column functions of a coordinate: energies and their derivatives.

Every family gives ``energy``, ``force`` (-dU/dx) and ``gradient`` (dU/dparameter
by name). Parameters are columns or numbers.
"""

import math
from dataclasses import dataclass
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Potential:
    """A family: each function takes the coordinate and the named parameters. Users add their own the same way."""

    names: tuple[str, ...]
    energy: Callable[..., Column]
    force: Callable[..., Column]
    gradient: Callable[..., dict[str, Column]]
    hessian: Callable[..., dict[tuple[str, str], Column]] | None = None  # second derivatives that are not zero; None of a family linear in all parameters
    bounds: dict[str, tuple[float | None, float | None]] | None = None  # parameter -> least and greatest value; None is open
    frozen: tuple[str, ...] = ()  # parameters that no fit moves

    def clamped(self, **parameters: float) -> dict[str, float]:
        """Parameters held inside their bounds; one of another name is an error."""
        unknown = set(parameters) - set(self.names)
        if unknown:
            raise ValueError(f"no parameters named {sorted(unknown)}; there are {self.names}")
        inside = {}
        for name, value in parameters.items():
            least, greatest = (self.bounds or {}).get(name, (None, None))
            value = value if least is None else max(value, least)
            inside[name] = value if greatest is None else min(value, greatest)
        return inside

    def free_gradient(self, x: Column, **parameters) -> dict[str, Column]:
        """The gradient by the parameters that are not frozen."""
        return {n: g for n, g in self.gradient(x, **parameters).items() if n not in self.frozen}


def _lennard_jones(m: int) -> Potential:
    """4 epsilon ((sigma/r)^m - (sigma/r)^6)."""
    q = lambda r, s: s / r
    power = lambda x, n: F.pow(x, F.lit(float(n)))
    return Potential(
        ("epsilon", "sigma"),
        lambda r, epsilon, sigma: 4 * epsilon * (power(q(r, sigma), m) - power(q(r, sigma), 6)),
        lambda r, epsilon, sigma: 4 * epsilon / r * (m * power(q(r, sigma), m) - 6 * power(q(r, sigma), 6)),
        lambda r, epsilon, sigma: {
            "epsilon": 4 * (power(q(r, sigma), m) - power(q(r, sigma), 6)),
            "sigma": 4 * epsilon / sigma * (m * power(q(r, sigma), m) - 6 * power(q(r, sigma), 6)),
        },
        lambda r, epsilon, sigma: {
            ("epsilon", "sigma"): 4 / sigma * (m * power(q(r, sigma), m) - 6 * power(q(r, sigma), 6)),
            ("sigma", "sigma"): 4 * epsilon / (sigma * sigma) * (m * (m - 1) * power(q(r, sigma), m) - 30 * power(q(r, sigma), 6)),
        },
    )


HARMONIC = Potential(
    ("k", "r0"),
    lambda x, k, r0: k * (x - r0) * (x - r0),
    lambda x, k, r0: -2 * k * (x - r0),
    lambda x, k, r0: {"k": (x - r0) * (x - r0), "r0": -2 * k * (x - r0)},
    lambda x, k, r0: {("k", "r0"): -2 * (x - r0), ("r0", "r0"): 2 * k + 0 * x},
)
LJ126, LJ96 = _lennard_jones(12), _lennard_jones(9)

_ROOT = math.sqrt(2 * math.pi)
GAUSSIAN = Potential(
    ("a", "r0", "s"),
    lambda r, a, r0, s: a / (s * _ROOT) * F.exp(-(r - r0) * (r - r0) / (2 * s * s)),
    lambda r, a, r0, s: a / (s * _ROOT) * F.exp(-(r - r0) * (r - r0) / (2 * s * s)) * (r - r0) / (s * s),
    lambda r, a, r0, s: (lambda u: {"a": u / a, "r0": u * (r - r0) / (s * s), "s": u * ((r - r0) * (r - r0) / (s * s) - 1) / s})(GAUSSIAN.energy(r, a, r0, s)),
    lambda r, a, r0, s: (lambda u, z: {
        ("a", "r0"): u / a * z / s, ("a", "s"): u / a * (z * z - 1) / s, ("r0", "r0"): u * (z * z - 1) / (s * s),
        ("r0", "s"): u * z * (z * z - 3) / (s * s), ("s", "s"): u * (z * z * z * z - 5 * z * z + 2) / (s * s),
    })(GAUSSIAN.energy(r, a, r0, s), (r - r0) / s),
)
DOUBLE_GAUSSIAN = Potential(
    ("a", "b", "c", "d"),
    lambda r, a, b, c, d: -(a * F.exp(-b * r * r) + c * F.exp(-d * r * r)),
    lambda r, a, b, c, d: -2 * r * (a * b * F.exp(-b * r * r) + c * d * F.exp(-d * r * r)),
    lambda r, a, b, c, d: {"a": -F.exp(-b * r * r), "b": a * r * r * F.exp(-b * r * r), "c": -F.exp(-d * r * r), "d": c * r * r * F.exp(-d * r * r)},
    lambda r, a, b, c, d: {
        ("a", "b"): r * r * F.exp(-b * r * r), ("b", "b"): -a * r * r * r * r * F.exp(-b * r * r),
        ("c", "d"): r * r * F.exp(-d * r * r), ("d", "d"): -c * r * r * r * r * F.exp(-d * r * r),
    },
)
COSINE_SOFT = Potential(
    ("a", "rc"),
    lambda r, a, rc: F.when(r < rc, a * (1 + F.cos(math.pi * r / rc))).otherwise(0.0),
    lambda r, a, rc: F.when(r < rc, a * math.pi / rc * F.sin(math.pi * r / rc)).otherwise(0.0),
    lambda r, a, rc: {"a": F.when(r < rc, 1 + F.cos(math.pi * r / rc)).otherwise(0.0), "rc": F.when(r < rc, a * math.pi * r / (rc * rc) * F.sin(math.pi * r / rc)).otherwise(0.0)},
    lambda r, a, rc: {
        ("a", "rc"): F.when(r < rc, math.pi * r / (rc * rc) * F.sin(math.pi * r / rc)).otherwise(0.0),
        ("rc", "rc"): F.when(r < rc, -a * math.pi * r / (rc * rc * rc) * (2 * F.sin(math.pi * r / rc) + math.pi * r / rc * F.cos(math.pi * r / rc))).otherwise(0.0),
    },
)


def soft_lennard_jones(n: float = 2.0, alpha: float = 0.5) -> Potential:
    """4 epsilon lambda^n (1/A^2 - 1/A) with A = alpha (1 - lambda)^2 + (r/sigma)^6: no pole at r = 0 for lambda < 1."""

    def parts(r, sigma, lam):
        a = alpha * (1 - lam) * (1 - lam) + F.pow(r / sigma, F.lit(6.0))
        return 1 / (a * a) - 1 / a, 1 / (a * a) - 2 / (a * a * a)  # g and dg/dA

    power = lambda lam, k: F.pow(lam if isinstance(lam, Column) else F.lit(float(lam)), F.lit(k))

    def gradient(r, epsilon, sigma, lam):
        g, slope = parts(r, sigma, lam)
        six = 6 * F.pow(r / sigma, F.lit(6.0))
        return {
            "epsilon": 4 * power(lam, n) * g,
            "sigma": -4 * epsilon * power(lam, n) * slope * six / sigma,
            "lam": 4 * epsilon * (n * power(lam, n - 1) * g - 2 * alpha * (1 - lam) * power(lam, n) * slope),
        }

    def hessian(r, epsilon, sigma, lam):
        six = F.pow(r / sigma, F.lit(6.0))
        a = alpha * (1 - lam) * (1 - lam) + six
        g, slope, curve = 1 / (a * a) - 1 / a, 1 / (a * a) - 2 / (a * a * a), 6 / (a * a * a * a) - 2 / (a * a * a)
        by_sigma, by_lam = -6 * six / sigma, -2 * alpha * (1 - lam)  # of a
        low, lower = n * power(lam, n - 1), n * (n - 1) * power(lam, n - 2)
        return {
            ("epsilon", "sigma"): 4 * power(lam, n) * slope * by_sigma,
            ("epsilon", "lam"): 4 * (low * g + power(lam, n) * slope * by_lam),
            ("sigma", "sigma"): 4 * epsilon * power(lam, n) * (curve * by_sigma * by_sigma + slope * 42 * six / (sigma * sigma)),
            ("sigma", "lam"): 4 * epsilon * (low * slope * by_sigma + power(lam, n) * curve * by_sigma * by_lam),
            ("lam", "lam"): 4 * epsilon * (lower * g + 2 * low * slope * by_lam + power(lam, n) * (curve * by_lam * by_lam + 2 * alpha * slope)),
        }

    return Potential(
        ("epsilon", "sigma", "lam"),
        lambda r, epsilon, sigma, lam: 4 * epsilon * power(lam, n) * parts(r, sigma, lam)[0],
        lambda r, epsilon, sigma, lam: -4 * epsilon * power(lam, n) * parts(r, sigma, lam)[1] * 6 * F.pow(r / sigma, F.lit(6.0)) / r,
        gradient,
        hessian,
    )


SOFT_LJ = soft_lennard_jones()


def _over(components: Column | list[dict], one: Callable) -> Column:
    """The sum of ``one`` over the components; a list that is known when the query is made is written out, which is compiled."""
    return F.aggregate(components, F.lit(0.0), lambda s, c: s + one(c)) if isinstance(components, Column) else sum((one(c) for c in components), F.lit(0.0))


def multi_gaussian_force(r: Column, components: Column | list[dict], cutoff: Column | float, normalised: bool = True) -> Column:
    """-dU/dr of ``multi_gaussian``."""
    if normalised:
        one = lambda c: c["a"] / (c["s"] * _ROOT) * F.exp(-(r - c["r0"]) * (r - c["r0"]) / (2 * c["s"] * c["s"])) * (r - c["r0"]) / (c["s"] * c["s"])
    else:
        one = lambda c: 2 * c["a"] * F.exp(-(r - c["r0"]) * (r - c["r0"]) / (c["s"] * c["s"])) * (r - c["r0"]) / (c["s"] * c["s"])
    return F.when(r <= cutoff, _over(components, one)).otherwise(0.0)


def with_boundary(base: Potential, x: Column, style: str, lower: float | None, upper: float | None, *, decay: float = 0.25, strength: float = 50.0, least_k: float = 1.0, **parameters) -> dict[str, Column]:
    """``energy``, ``force`` and the gradients of a potential that goes on in a fixed way outside [lower, upper].

    Pairs have an exponential core below; bonds a harmonic wall on either side;
    angles one below, and are flat above. A wall is as stiff as the force is steep
    at its end, at least ``least_k``. Gradients are zero outside.
    """
    at = lambda v: F.lit(float(v))
    energy, force = base.energy(x, **parameters), base.force(x, **parameters)

    def stiffness(end: float, inner: int):
        eps = max(abs(end) * 1e-4, 1e-4)
        slope = (base.force(at(end + inner * eps), **parameters) - base.force(at(end), **parameters)) / eps
        return F.greatest(F.abs(slope), F.lit(least_k))

    inside = F.lit(True)
    if lower is not None and style in ("pair", "bond", "angle"):
        below, start = x < lower, base.energy(at(lower), **parameters)
        if style == "pair":
            height = F.greatest(F.abs(base.force(at(lower), **parameters)), F.lit(strength))
            grown = F.exp((lower - x) / decay)
            out = start + height * decay * (grown - 1), height * grown
        else:
            k = stiffness(lower, 1)
            out = start + 0.5 * k * (x - lower) * (x - lower), k * (lower - x)
        energy, force, inside = F.when(below, out[0]).otherwise(energy), F.when(below, out[1]).otherwise(force), inside & ~below
    if upper is not None and style in ("bond", "angle"):
        above, start = x > upper, base.energy(at(upper), **parameters)
        k = stiffness(upper, -1) if style == "bond" else F.lit(0.0)
        energy = F.when(above, start + 0.5 * k * (x - upper) * (x - upper)).otherwise(energy)
        force, inside = F.when(above, -k * (x - upper)).otherwise(force), inside & ~above
    return {"energy": energy, "force": force} | {name: F.when(inside, g).otherwise(0.0) for name, g in base.gradient(x, **parameters).items()}


def multi_gaussian(r: Column, components: Column | list[dict], cutoff: Column | float, normalised: bool = True) -> Column:
    """Sum over an array of structs (a, r0, s), or a list of dicts; zero past the cutoff. Not normalised: a exp(-((r - r0)/s)^2)."""
    one = (lambda c: c["a"] / (c["s"] * _ROOT) * F.exp(-(r - c["r0"]) * (r - c["r0"]) / (2 * c["s"] * c["s"]))) if normalised else (lambda c: c["a"] * F.exp(-(r - c["r0"]) * (r - c["r0"]) / (c["s"] * c["s"])))
    return F.when(r <= cutoff, _over(components, one)).otherwise(0.0)


def gate(log_alpha: Column, low: float = -0.1, high: float = 1.1, beta: float = 2 / 3) -> tuple[Column, Column]:
    """Hard-concrete gate value and the probability that it is open."""
    z = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.exp(-log_alpha)) * (high - low) + low))
    return z, 1 / (1 + F.exp(-(log_alpha - beta * math.log(-low / high))))


def _open_share(log_alpha: Column) -> tuple[Column, Column]:
    """The stretched sigmoid of a gate before it is clipped, and its slope."""
    low, high = GATE
    s = 1 / (1 + F.exp(-log_alpha))
    return s * (high - low) + low, s * (1 - s) * (high - low)


GATE = (-0.1, 1.1)


def gated(base: Potential) -> Potential:
    """The family under a hard-concrete gate, with ``log_alpha`` as its last parameter.

    Energy, force and the gradients of the family's own parameters are scaled by
    the gate value; the gradient by ``log_alpha`` is the energy times the gate's slope,
    which is 0 where the gate is clipped. There are no second derivatives: gates are for first-order steps.
    """

    def inner(function, x, parameters):
        own = {k: v for k, v in parameters.items() if k != "log_alpha"}
        raw, slope = _open_share(parameters["log_alpha"] if isinstance(parameters["log_alpha"], Column) else F.lit(float(parameters["log_alpha"])))
        z = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
        return function(x, **own), z, F.when((raw > 0) & (raw < 1), slope).otherwise(0.0)

    def scaled(function):
        def value(x, **parameters):
            v, z, _ = inner(function, x, parameters)
            return v * z

        return value

    def gradient(x, **parameters):
        g, z, slope = inner(base.gradient, x, parameters)
        return {k: v * z for k, v in g.items()} | {"log_alpha": inner(base.energy, x, parameters)[0] * slope}

    return Potential((*base.names, "log_alpha"), scaled(base.energy), scaled(base.force), gradient)


def gate_penalty(log_alpha: Column, strength: float, beta: float = 2 / 3) -> tuple[Column, Column]:
    """The strength times the probability that a gate is open, and its slope by ``log_alpha``."""
    _, p = gate(log_alpha, *GATE, beta)
    return strength * p, strength * p * (1 - p)


def legendre_basis(x: Column, n: int, a: float, b: float) -> Column:
    """``values, slopes``: arrays of the first n orthonormal Legendre polynomials on [a, b] and of their derivatives by x, by the recurrence over degrees."""
    t = (2 * x - (a + b)) / (b - a)
    if n <= 12:  # few degrees are written out as polynomials, which are compiled; of many the coefficients cancel
        powers = [np.polynomial.legendre.leg2poly([0.0] * k + [1.0]) * math.sqrt((2 * k + 1) / (b - a)) for k in range(n)]
        horner = lambda cs: F.lit(float(cs[-1])) if len(cs) == 1 else horner(cs[1:]) * t + float(cs[0])
        slopes = [np.polynomial.polynomial.polyder(p) * 2 / (b - a) for p in powers]
        return F.struct(F.array(*map(horner, powers)).alias("values"), F.array(*map(horner, slopes)).alias("slopes"))
    start = F.struct(t.alias("t"), F.array(F.lit(1.0), t).alias("v"), F.array(F.lit(0.0), F.lit(1.0)).alias("d"))

    def grown(s: Column, k: Column) -> Column:
        last, older = lambda c: F.element_at(c, -1), lambda c: F.element_at(c, -2)
        value = ((2 * k + 1) * s.t * last(s.v) - k * older(s.v)) / (k + 1)
        slope = ((2 * k + 1) * (last(s.v) + s.t * last(s.d)) - k * older(s.d)) / (k + 1)
        return F.struct(s.t.alias("t"), F.concat(s.v, F.array(value)).alias("v"), F.concat(s.d, F.array(slope)).alias("d"))

    degrees = F.array(*map(F.lit, range(1, n - 1))) if n > 2 else F.array().cast("array<int>")
    scaled = lambda c, factor: F.transform(F.slice(c, 1, n), lambda v, k: v * factor * F.sqrt((2 * k + 1) / F.lit(b - a)))
    return F.aggregate(degrees, start, grown, lambda s: F.struct(scaled(s.v, 1.0).alias("values"), scaled(s.d, 2 / (b - a)).alias("slopes")))


def cosine_slope(x: Column, m: Column, a: float, b: float) -> Column:
    """Derivatives of ``cosine_basis`` by x."""
    rate = math.pi * m / (b - a)
    return F.when(m == 0, F.lit(0.0)).otherwise(-math.sqrt(2 / (b - a)) * rate * F.sin(rate * (x - a)))


def cosine_basis(x: Column, m: Column, a: float, b: float) -> Column:
    """Orthonormal cosines on [a, b]."""
    scaled = math.pi * m * (x - a) / (b - a)
    return F.when(m == 0, F.lit(math.sqrt(1 / (b - a)))).otherwise(math.sqrt(2 / (b - a)) * F.cos(scaled))


def hat(x: Column, k: Column, lo: float, step: float) -> Column:
    """Degree-1 spline basis number k on a uniform grid."""
    return F.greatest(F.lit(0.0), 1 - F.abs((x - lo) / step - k))
