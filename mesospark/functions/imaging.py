"""Periodic imaging as column functions. Lengths are cell edges; triclinic cells are lower-triangular edge vectors."""

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def minimum_image(d: Column, length: Column) -> Column:
    """Nearest image in a rectangular cell; halves round to even."""
    return d - length * F.rint(d / length)


def single_shift_image(d: Column, length: Column) -> Column:
    """At most one cell length is taken off, whatever the distance; tilt is ignored."""
    return d - length * F.greatest(F.least(F.rint(d / length), F.lit(1.0)), F.lit(-1.0))


def wrap(x: Column, length: Column) -> Column:
    """Into [0, length), also after a cast to float; a cell length that is not positive changes nothing."""
    inside = x - length * F.floor(x / length)
    inside = F.when(inside.cast("float") >= length.cast("float"), F.lit(0.0)).otherwise(inside)
    return F.when(length > 0, inside).otherwise(x)


def normalise_angle(phi: Column) -> Column:
    """Degrees into [-180, 180)."""
    return phi + 180.0 - 360.0 * F.floor((phi + 180.0) / 360.0) - 180.0


def edge_vectors(lx: Column, ly: Column, lz: Column, alpha: Column, beta: Column, gamma: Column) -> list[list[Column]]:
    """Rows a, b, c of the lower-triangular cell matrix; angles in degrees."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    cy = lz * (ca - cb * cg) / sg
    zero = F.lit(0.0)
    return [[lx, zero, zero], [ly * cg, ly * sg, zero], [lz * cb, cy, F.sqrt(lz * lz - lz * lz * cb * cb - cy * cy)]]


def triclinic_fast(d: list[Column], cell: list[list[Column]]) -> list[Column]:
    """Rounded fractional coordinates; not the shortest image in strongly skewed cells."""
    out = list(d)
    for axis in (2, 1, 0):
        n = F.rint(out[axis] / cell[axis][axis])
        out = [x - n * e for x, e in zip(out, cell[axis], strict=True)]
    return out


_SHIFTS = list(product((-1.0, 0.0, 1.0), repeat=3))


def triclinic_exact(d: list[Column], cell: list[list[Column]]) -> Column:
    """Struct ``square, x, y, z`` of the shortest of the 27 images around the fast one; of equally short ones the least vector."""
    bound = F.struct(*[c.alias(n) for n, c in zip("xyz", triclinic_fast(d, cell), strict=True)], *[cell[i][n].alias(f"e{i}{n}") for i in range(3) for n in range(3)])
    shifts = F.array(*[F.array(*map(F.lit, s)) for s in _SHIFTS])

    def image(b, s):
        p, q, r = (b[c] + s[0] * b[f"e0{n}"] + s[1] * b[f"e1{n}"] + s[2] * b[f"e2{n}"] for n, c in enumerate("xyz"))
        return F.struct((p * p + q * q + r * r).alias("square"), p.alias("x"), q.alias("y"), r.alias("z"))

    # the cell is bound once, and each image is made from what is bound
    return F.transform(F.array(bound), lambda b: F.array_min(F.transform(shifts, lambda s: image(b, s))))[0]


def triclinic_square(near: list[Column], cell: list[list[Column]]) -> Column:
    """The squared length alone of ``triclinic_exact``, from the fast image in columns of its own; it is compiled, as it binds nothing.

    Of the three images along a, the nearest is the one at |x| or one edge nearer to 0.
    """
    squares = []
    for j, k in product((-1.0, 0.0, 1.0), repeat=2):
        x = F.abs(near[0] + j * cell[1][0] + k * cell[2][0])
        x = F.least(x, F.abs(x - cell[0][0]))
        y, z = near[1] + j * cell[1][1] + k * cell[2][1], near[2] + k * cell[2][2]
        squares.append(x * x + y * y + z * z)
    return F.least(*squares)


def cell_class(lx: Column, ly: Column, lz: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """none, ortho or triclinic."""
    some = (lx > 0) & (ly > 0) & (lz > 0)
    square = (F.abs(alpha - 90) < 1e-6) & (F.abs(beta - 90) < 1e-6) & (F.abs(gamma - 90) < 1e-6)
    return F.when(~some, "none").when(square, "ortho").otherwise("triclinic")


def cell_metrics(cell: list[list[Column]]) -> dict[str, Column]:
    """Volume, the three heights between opposite faces, and half the least height."""
    a, b, c = cell
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    norm = lambda u: F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])
    volume = F.abs(a[0] * b[1] * c[2])
    heights = [volume / norm(cross(u, v)) for u, v in ((b, c), (c, a), (a, b))]
    return {"volume": volume, "ha": heights[0], "hb": heights[1], "hc": heights[2], "half_min_height": F.least(*heights) / 2}
