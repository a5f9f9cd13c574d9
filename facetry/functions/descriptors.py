"""Pairwise and per-triangle descriptors built on vectors and tensors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.functions import tensor as t


def ionic_character(chi_u: Column, chi_v: Column) -> Column:
    """1 - exp(-(difference)^2 / 4)."""
    return 1 - F.exp(-((chi_u - chi_v) * (chi_u - chi_v)) / 4)


def charge_imbalance(q_u: Column, q_v: Column) -> Column:
    """Signed difference over the sum of absolute values; 0 where both vanish."""
    return g.safe_div(q_v - q_u, F.abs(q_u) + F.abs(q_v), 0.0)


def density_slope(rho_u: Column, rho_v: Column, distance: Column) -> Column:
    return g.safe_div(F.abs(rho_v - rho_u), distance)


def axis_alignment(bond: Column, axis: Column) -> Column:
    """exp(-|[M_bond, M_axis]|_F) for the generators of two directions; 1 for a zero vector, NULL for a null component.

    The commutator of two generators is that of their cross product, so its norm is sqrt(2) sin of the angle. Plain
    arithmetic, since it is asked for every bond: bound variables are interpreted, not compiled.
    """
    cross = [bond[i] * axis[j] - bond[j] * axis[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    m, n, size = (F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2]) for x in (bond, axis, cross))
    sine = F.when((m > g.TOLERANCE) & (n > g.TOLERANCE), size / F.when(m > g.TOLERANCE, m) / F.when(n > g.TOLERANCE, n))
    return F.exp(-math.sqrt(2) * F.when(m.isNotNull() & n.isNotNull(), F.coalesce(sine, F.lit(0.0))))


def environment_alignment(a: Column, b: Column) -> Column:
    """0.4 of the normalised inner product, 0.4 of the principal directions' cosine, 0.2 of the cosine
    similarity of the tensors, clipped to [0, 1]."""
    directions = g.let2(t.principal_direction(a), t.principal_direction(b), lambda u, v: F.abs(g.dot(u, v)))
    return g.clip(0.6 * t.alignment(a, b) + 0.4 * directions, 0, 1)


def pseudo_symplectic(q: Column, p: Column) -> Column:
    """H + 0.1 |w| + 0.05 L + 0.01 scale of two vectors taken as position and momentum."""
    of = lambda x, y: g.let(g.dot(x, x) + g.dot(y, y), lambda n: n / 2 + 0.1 * F.abs(g.dot(x, y)) + 0.05 * g.norm(g.cross(x, y)) + 0.01 * F.sqrt(n))
    return g.let2(q, p, of)


def symplectic_coupling(bond: Column, gradient: Column) -> Column:
    return g.norm(g.cross(bond, gradient))


def free_energy(distortion: Column, anisotropy: Column, valence_gap: Column, quotient: Column, entropy: Column) -> Column:
    """(distortion + anisotropy + |valence gap|) - (1 - quotient) * entropy."""
    return (distortion + anisotropy + F.abs(valence_gap)) - (1 - quotient) * entropy


def stress_flow(p: Column, q: Column, r: Column, w_pq: Column, w_qr: Column, w_rp: Column) -> Column:
    """Norm of the sum of the sides' outward in-plane unit normals, weighted by each side's value."""
    normal = g.unit(g.cross(g.sub(q, p), g.sub(r, p)))
    side = lambda n, v, w: g.let(g.cross(g.unit(v), n), lambda x: g.scale(x, w))
    total = lambda n: g.let3(side(n, g.sub(q, p), w_pq), side(n, g.sub(r, q), w_qr), side(n, g.sub(p, r), w_rp), lambda a, b, c: g.add(g.add(a, b), c))
    return g.norm(g.let(normal, total))


def gradient_flux(grads: list[Column], p: Column, q: Column, r: Column) -> Column:
    """Mean vertex gradient through the triangle: its dot product with half the sides' cross product."""
    mean = F.array(*[(grads[0][i] + grads[1][i] + grads[2][i]) / 3 for i in range(3)])
    return g.let2(mean, g.cross(g.sub(q, p), g.sub(r, p)), lambda m, n: g.dot(m, n) / 2)


def normal_projection(tensors: list[Column], p: Column, q: Column, r: Column) -> Column:
    """n^T (sum of tensors) n; NULL for collinear points."""
    total = F.array(*[tensors[0][i] + tensors[1][i] + tensors[2][i] for i in range(9)])
    return g.let2(g.cross(g.sub(q, p), g.sub(r, p)), total, lambda n, m: F.when(g.norm(n) > g.TOLERANCE, t.quadratic(m, g.unit(n))))


def reduction_factor(a: Column, b: Column, c: Column) -> Column:
    """Least over mean of three positive orders."""
    return g.safe_div(F.least(a, b, c), (a + b + c) / 3)


def scaled_cosine_error(a: Column, b: Column, gamma: float = 2.0) -> Column:
    """(1 - cosine)^gamma of two vectors of any one length; the cosine with a zero vector is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    of = lambda x, y: g.let(F.sqrt(dot(x, x) * dot(y, y)), lambda m: g.safe_div(dot(x, y), m, 0.0))
    return F.pow(1 - g.let2(a, b, of), F.lit(gamma))


def wrap_norm(image_sum: Column, cell: Column, length: Column) -> Column:
    """Norm of the Cartesian sum of image vectors over the number of points of a path."""
    return g.norm(g.frac_to_cart(cell, image_sum)) / length
