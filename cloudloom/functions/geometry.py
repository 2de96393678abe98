"""Column expressions on points, normals, colours, keys and edges. All stay in whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits that a packed voxel key keeps of each cell index, and the offset that makes it positive.
KEY_BITS = 21
KEY_OFFSET = 1 << (KEY_BITS - 1)
#: The multipliers of the three cell indices in a hash key.
HASH_PRIMES = (73856093, 19349663, 83492791)
#: Lengths at or below it don't give a direction.
EPSILON = 1e-12


def is_finite(*columns: Column) -> Column:
    """Whether no column is null, NaN or infinite."""
    test = F.lit(True)
    for c in columns:
        test = test & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return test


def cell_index(c: Column, distance: float) -> Column:
    """The index of the grid cell of a coordinate, by the reciprocal of the cell's width."""
    if not distance > 0:
        raise ValueError("the distance must be positive")
    return F.floor(c * F.lit(1.0 / distance)).cast("int")


def pack_key(ix: Column, iy: Column, iz: Column) -> Column:
    """One long from three cell indices; indices 2**21 apart on an axis wrap to the same key."""
    low = F.lit((1 << KEY_BITS) - 1).cast("long")
    field = lambda c: (c.cast("long") + KEY_OFFSET).bitwiseAND(low)
    return F.shiftleft(field(ix), 2 * KEY_BITS).bitwiseOR(F.shiftleft(field(iy), KEY_BITS)).bitwiseOR(field(iz))


def hash_key(ix: Column, iy: Column, iz: Column) -> Column:
    """The xor of the indices times HASH_PRIMES. Each product fits a long, so nothing wraps."""
    x, y, z = (c.cast("long") * p for c, p in zip((ix, iy, iz), HASH_PRIMES, strict=True))
    return x.bitwiseXOR(y).bitwiseXOR(z)


def colour_u8(c: Column) -> Column:
    """A colour as 0 to 255: values in [0, 1] are shares of 255, rounded; others are clamped and truncated."""
    share = F.floor(c * 255.0 + 0.5)
    return F.when(c.between(0.0, 1.0), share).otherwise(F.floor(F.greatest(F.least(c, F.lit(255.0)), F.lit(0.0)))).cast("short")


def tokens(line: Column) -> Column:
    """The words of a line, parted by white space."""
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def parse_double(word: Column) -> Column:
    """The number that a word spells, or null."""
    return word.try_cast("double")


def parse_long(word: Column) -> Column:
    return word.try_cast("long")


Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def normalized(a: Vector) -> list[Column]:
    """a at length one; zero if its length is at most EPSILON."""
    n = norm(a)
    return [F.when(n > EPSILON, x / n).otherwise(F.lit(0.0)) for x in a]


def valid_normal(a: Vector) -> Column:
    """Whether a has a positive finite squared length."""
    n = dot(a, a)
    return is_finite(n) & (n > 0)


def axis_code(c: Column, depth: int) -> Column:
    """The cell index, from 0, of a coordinate in [-1, 1] at this depth; outside points take the border's cell."""
    cells = 1 << depth
    index = F.floor((c + 1.0) * (cells / 2.0)).cast("long")
    # (c + 1) rounds a tiny negative c up to the upper half
    index = F.when((c < 0) & (index >= cells // 2), F.lit(cells // 2 - 1)).otherwise(index)
    return F.greatest(F.least(index, F.lit(cells - 1)), F.lit(0)).cast("long")


def interleave(ix: Column, iy: Column, iz: Column, depth: int) -> Column:
    """The Morton code of three cell indices: three bits a level, x lowest."""
    code = F.lit(0).cast("long")
    for level in range(depth):
        for axis, c in enumerate((ix, iy, iz)):
            bit = F.shiftright(c, level).bitwiseAND(F.lit(1).cast("long"))
            code = code.bitwiseOR(F.shiftleft(bit, 3 * level + axis))
    return code


def octant_code(x: Column, y: Column, z: Column, depth: int) -> Column:
    """The octree code of a point of the cube [-1, 1]**3: its octants from the root down, upper halves as ones."""
    return interleave(axis_code(x, depth), axis_code(y, depth), axis_code(z, depth), depth)


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    """The area of a triangle by its Gram determinant, at least zero."""
    u, v = minus(b, a), minus(c, a)
    gram = dot(u, u) * dot(v, v) - dot(u, v) * dot(u, v)
    return F.sqrt(F.greatest(gram, F.lit(0.0))) / 2.0


def edge_low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def edge_high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def crossing(a: Column, b: Column, value_a: Column, value_b: Column, level: float) -> Column:
    """Where on the way from a to b the value passes the level, linearly."""
    t = (F.lit(level) - value_a) / (value_b - value_a)
    return a * (1.0 - t) + b * t


def affine(point: Vector, rows: Sequence[Sequence[float]]) -> list[Column]:
    """A point under an affine map, given as three rows of four numbers."""
    return [dot(point, [F.lit(float(v)) for v in row[:3]]) + float(row[3]) for row in rows]


def polynomial(c: Column, coefficients: Sequence[float]) -> Column:
    """A polynomial, constant term first, by Horner's rule."""
    out = F.lit(0.0)
    for value in reversed(coefficients):
        out = out * c + float(value)
    return out


def derivative(coefficients: Sequence[float]) -> list[float]:
    return [k * v for k, v in enumerate(coefficients)][1:]


def integral(coefficients: Sequence[float], low: float, high: float) -> float:
    """The integral of a polynomial over an interval."""
    return sum(v * (high ** (k + 1) - low ** (k + 1)) / (k + 1) for k, v in enumerate(coefficients))


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """The sorted real roots of a x**2 + b x + c, also where a is zero."""
    d = b * b - 4.0 * a * c
    root = F.sqrt(F.greatest(d, F.lit(0.0)))
    none = F.array().cast("array<double>")
    two = F.sort_array(F.array((-b - root) / (2.0 * a), (-b + root) / (2.0 * a)))
    curved = F.when(d > 0, two).when(d == 0, F.array(-b / (2.0 * a))).otherwise(none)
    return F.when(a != 0, curved).when(b != 0, F.array(-c / b)).otherwise(none)


def bspline_weights(t: Column) -> list[Column]:
    """The three quadratic B-spline weights of the cells before, at and after a point at t in [0, 1] of its cell."""
    return [0.5 * (1.0 - t) * (1.0 - t), 0.5 + t - t * t, 0.5 * t * t]


def random_ball_point(seed: int = 0) -> list[Column]:
    """A random point of the unit ball."""
    direction = random_sphere_point(seed)
    radius = F.pow(F.rand(seed + 3), F.lit(1.0 / 3.0))
    return [c * radius for c in direction]


def random_sphere_point(seed: int = 0) -> list[Column]:
    """A random point of the unit sphere: uniform height, uniform angle."""
    height, angle = F.rand(seed) * 2.0 - 1.0, F.rand(seed + 1) * 6.283185307179586
    ring = F.sqrt(F.greatest(1.0 - height * height, F.lit(0.0)))
    return [ring * F.cos(angle), ring * F.sin(angle), height]
