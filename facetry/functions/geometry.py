"""Vectors (arrays of 3 doubles) and cells (row-major arrays of 9) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-10


def vec(*xs: Column | str | float) -> Column:
    return F.array(*[(x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))).cast("double") for x in xs])


def let(value: Column, body) -> Column:
    """body(x) with x = value computed once: keeps nested formulas from repeating their operands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let2(a: Column, b: Column, body) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: body(s["a"], s["b"]))


def let3(a: Column, b: Column, c: Column, body) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), lambda s: body(s["a"], s["b"], s["c"]))


def add(a: Column, b: Column, n: int = 3) -> Column:
    return F.array(*[a[i] + b[i] for i in range(n)])


def sub(a: Column, b: Column, n: int = 3) -> Column:
    return F.array(*[a[i] - b[i] for i in range(n)])


def scale(a: Column, s: Column | float, n: int = 3) -> Column:
    return F.array(*[a[i] * s for i in range(n)])


def dot(a: Column, b: Column, n: int = 3) -> Column:
    out = a[0] * b[0]
    for i in range(1, n):
        out = out + a[i] * b[i]
    return out


def cross(a: Column, b: Column) -> Column:
    return let2(a, b, _cross)


def _cross(a: Column, b: Column) -> Column:
    return F.array(*[a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def norm(a: Column, n: int = 3) -> Column:
    return let(a, lambda x: F.sqrt(dot(x, x, n)))


def safe_div(a: Column, b: Column, otherwise: Column | float | None = None, tol: float = TOLERANCE) -> Column:
    """a / b where b > tol, else ``otherwise``: the guard against zero vectors and degenerate shapes."""
    return F.when(b > tol, a / F.when(b > tol, b)).otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def unit(a: Column) -> Column:
    """The unit vector; zero vectors stay zero."""
    return let(a, lambda x: let(norm(x), lambda n: F.array(*[safe_div(x[i], n, 0.0) for i in range(3)])))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def angle(a: Column, b: Column) -> Column:
    """Angle between two vectors; NULL for a zero vector."""

    def of(x: Column, y: Column) -> Column:
        return let(norm(x) * norm(y), lambda n: F.when(n > TOLERANCE, F.acos(clip(dot(x, y) / F.when(n > TOLERANCE, n), -1, 1))))

    return let2(a, b, of)


def lattice(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Cell lengths and angles (degrees) to row vectors: b in the a-b plane of a, c upright as far as it can be."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    cy = (ca - cb * cg) / sg
    zero = F.lit(0.0)
    return F.array(a, zero, zero, b * cg, b * sg, zero, c * cb, c * cy, c * F.sqrt(1 - cb * cb - cy * cy))


def frac_to_cart(cell: Column, f: Column) -> Column:
    return F.array(*[f[0] * cell[j] + f[1] * cell[3 + j] + f[2] * cell[6 + j] for j in range(3)])


def inverse(m: Column) -> Column:
    """3x3 inverse by cofactors; NULL entries for a flat cell."""
    return let(m, lambda x: let(determinant(x), lambda det: _inverse(x, det)))


def _inverse(m: Column, det: Column) -> Column:
    cof = []
    for i in range(3):
        for j in range(3):
            r, s = [k for k in range(3) if k != j], [k for k in range(3) if k != i]
            minor = m[3 * r[0] + s[0]] * m[3 * r[1] + s[1]] - m[3 * r[0] + s[1]] * m[3 * r[1] + s[0]]
            cof.append(F.when(F.abs(det) > 1e-300, (minor if (i + j) % 2 == 0 else -minor) / F.when(F.abs(det) > 1e-300, det)))
    return F.array(*cof)


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def cart_to_frac(cell: Column, x: Column) -> Column:
    return let(inverse(cell), lambda inv: frac_to_cart(inv, x))


def wrap01(x: Column) -> Column:
    return x - F.floor(x)


def nearest_image(delta: Column) -> Column:
    """Fractional difference moved to the nearest image of an orthogonal cell."""
    return F.array(*[delta[i] - F.bround(delta[i]) for i in range(3)])


def midpoint(p: Column, q: Column) -> Column:
    """Middle of two points."""
    return scale(add(p, q), 0.5)


def barycentre(p: Column, q: Column, r: Column) -> Column:
    """Mean of three points."""
    return scale(add(add(p, q), r), 1 / 3)


def triangle(p: Column, q: Column, r: Column) -> Column:
    """Struct: area, angle_variance, shape_factor, sphericity, circumradius2, of three points."""
    return let3(sub(q, p), sub(r, q), sub(p, r), _triangle)


def _triangle(pq: Column, qr: Column, rp: Column) -> Column:
    sides = F.array(norm(qr), norm(rp), norm(pq), norm(cross(pq, rp)) / 2)
    back = lambda v: scale(v, -1.0)
    angles = F.array(angle(pq, back(rp)), angle(back(pq), qr), angle(rp, back(qr)))
    spread = let(angles, lambda x: let((x[0] + x[1] + x[2]) / 3, lambda m: ((x[0] - m) ** 2 + (x[1] - m) ** 2 + (x[2] - m) ** 2) / 3))

    def shape(x: Column) -> Column:
        a, b, c, area = x[0], x[1], x[2], x[3]
        around = a + b + c
        s = around / 2
        heron = F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c)))
        return let2(heron, safe_div(a * b * c, 4 * heron, 0.0), lambda h, radius: F.struct(
            area.alias("area"), clip(safe_div(12 * 3**0.5 * area, around * around, 0.0), 0, 1).alias("shape_factor"),
            safe_div(safe_div(h, s, 0.0), radius, 0.0).alias("sphericity"), F.when((area > TOLERANCE) & (around > TOLERANCE), radius * radius).alias("circumradius2")))

    return let2(let(sides, shape), spread, lambda x, v: F.struct(x["area"].alias("area"), v.alias("angle_variance"), x["shape_factor"].alias("shape_factor"), x["sphericity"].alias("sphericity"), x["circumradius2"].alias("circumradius2")))


def solid_angle(a: Column, b: Column, c: Column) -> Column:
    """Solid angle of three directions; 0 for zero vectors or a closed denominator."""

    def of(x: Column, y: Column, z: Column) -> Column:
        nx, ny, nz = norm(x), norm(y), norm(z)
        below = nx * ny * nz + dot(x, y) * nz + dot(x, z) * ny + dot(y, z) * nx
        return let2(below, F.least(nx, ny, nz), lambda w, n: F.when((n >= TOLERANCE) & (w > TOLERANCE), 2 * F.atan2(F.abs(dot(x, cross(y, z))), w)).otherwise(0.0))

    return let3(a, b, c, of)
