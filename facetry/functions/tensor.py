"""3x3 tensors as row-major arrays of 9 doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.functions.geometry import TOLERANCE, clip, cross, determinant, dot, let, let2, norm, safe_div, unit

__all__ = ["alignment", "anisotropy", "commutator", "determinant", "eigenvalues", "frobenius", "inner", "is_skew", "lie_generator", "lie_norm", "matmul", "principal_angle", "principal_direction", "quadratic", "skew", "symmetric", "trace", "transpose"]


def symmetric(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    return F.array(xx, xy, xz, xy, yy, yz, xz, yz, zz)


def trace(t: Column) -> Column:
    return t[0] + t[4] + t[8]


def transpose(t: Column) -> Column:
    return F.array(*[t[3 * j + i] for i in range(3) for j in range(3)])


def matmul(a: Column, b: Column) -> Column:
    return let2(a, b, _matmul)


def _matmul(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def inner(a: Column, b: Column) -> Column:
    """tr(A^T B)."""
    return dot(a, b, 9)


def frobenius(t: Column) -> Column:
    return norm(t, 9)


def commutator(a: Column, b: Column) -> Column:
    return let2(a, b, lambda p, q: let2(_matmul(p, q), _matmul(q, p), lambda x, y: F.array(*[x[i] - y[i] for i in range(9)])))


def alignment(a: Column, b: Column) -> Column:
    """tr(A^T B) / (|A| |B|); NULL when a norm vanishes."""
    of = lambda x, y: let2(frobenius(x), frobenius(y), lambda m, n: F.when((m > TOLERANCE) & (n > TOLERANCE), safe_div(inner(x, y), m * n, tol=0.0)))
    return let2(a, b, of)


def eigenvalues(t: Column) -> Column:
    """Eigenvalues of a symmetric tensor, largest first, by the trigonometric closed form."""
    return let(t, lambda x: let(trace(x) / 3, lambda q: _eigenvalues(x, q)))


def _eigenvalues(t: Column, q: Column) -> Column:
    off = t[1] * t[1] + t[2] * t[2] + t[5] * t[5]
    spread = F.sqrt(((t[0] - q) * (t[0] - q) + (t[4] - q) * (t[4] - q) + (t[8] - q) * (t[8] - q) + 2 * off) / 6)
    shifted = lambda p: F.array(*[safe_div(t[i] - (q if i in (0, 4, 8) else F.lit(0.0)), p, 0.0, tol=1e-150) for i in range(9)])
    turn = lambda p: let(shifted(p), lambda b: F.acos(clip(determinant(b) / 2, -1, 1)) / 3)
    ends = let(spread, lambda p: let(turn(p), lambda phi: F.array(q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3))))
    return let(ends, lambda e: F.array(e[0], 3 * q - e[0] - e[1], e[1]))


def anisotropy(t: Column) -> Column:
    """sqrt(3/2 tr(T^2)/tr(T)^2 - 1/2): equal to the eigenvalue form; 0 for a vanishing trace."""
    of = lambda x, tr: F.when(tr > 1e-12, F.sqrt(F.greatest(F.lit(0.0), 1.5 * safe_div(inner(x, transpose(x)), tr * tr, tol=0.0) - 0.5))).otherwise(0.0)
    return let(t, lambda x: let(trace(x), lambda tr: of(x, tr)))


def principal_direction(t: Column) -> Column:
    """Unit eigenvector of the largest eigenvalue: the longest cross product of two rows of T - l I.

    Its sign is free; for a repeated largest eigenvalue it is the zero vector.
    """
    rows = lambda x, top: F.array(*[F.array(*[x[3 * i + j] - (top if i == j else F.lit(0.0)) for j in range(3)]) for i in range(3)])
    crossed = lambda r: F.array(*[let(cross(r[i], r[j]), lambda c: F.struct(norm(c).alias("n"), c.alias("c"))) for i, j in ((0, 1), (0, 2), (1, 2))])
    return let(t, lambda x: unit(F.array_max(let(let(eigenvalues(x)[0], lambda top: rows(x, top)), crossed))["c"]))


def skew(v: Column) -> Column:
    """[v]x; the zero tensor for vectors under 1e-12."""
    z = F.lit(0.0)
    return let(v, lambda x: F.when(norm(x) < 1e-12, F.array(*[z] * 9)).otherwise(F.array(z, -x[2], x[1], x[2], z, -x[0], -x[1], x[0], z)))


def lie_generator(v: Column) -> Column:
    """so(3) generator of the normalised first three components; zero for a vanishing vector."""
    return skew(unit(v))


def is_skew(t: Column, tol: float = 1e-10) -> Column:
    return let(t, lambda x: _is_skew(x, tol))


def _is_skew(t: Column, tol: float) -> Column:
    return F.greatest(*[F.abs(t[3 * i + j] + t[3 * j + i]) for i in range(3) for j in range(i, 3)]) <= tol


def lie_norm(t: Column) -> Column:
    return let(t, lambda x: F.when(is_skew(x), frobenius(x)))


def principal_angle(t: Column) -> Column:
    """sqrt(-tr(M^2) / 2); NULL unless antisymmetric."""
    return let(t, lambda x: F.when(is_skew(x), F.sqrt(F.greatest(F.lit(0.0), let(matmul(x, x), lambda y: -trace(y) / 2)))))


def quadratic(t: Column, v: Column) -> Column:
    """v^T T v."""
    return let2(t, v, lambda m, x: dot(x, F.array(*[m[3 * i] * x[0] + m[3 * i + 1] * x[1] + m[3 * i + 2] * x[2] for i in range(3)])))
