"""Quaternions (w, x, y, z), vectors and 3 x 3 matrices as array Columns.

Pass columns, not long expressions: each function refers to its arguments many
times, so keep each step as a column of its own (``withColumn``).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(*x: Column) -> Column:
    return F.array(*x)


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return reduce(add, [a[i] * b[i] for i in range(n)])


def norm(a: Column, n: int = 3) -> Column:
    return F.sqrt(dot(a, a, n))


def cross(a: Column, b: Column) -> Column:
    return F.array(*[a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)])


def vector_angle(a: Column, b: Column) -> Column:
    """Angle in radians, null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))))


def quat_mul(p: Column, q: Column) -> Column:
    """Hamilton product."""
    a, b, c, d = (p[i] for i in range(4))
    e, f, g, h = (q[i] for i in range(4))
    return F.array(a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


def quat_of_vector(r: Column, tiny: float = 1e-8) -> Column:
    """The rotation by a rotation vector; near zero by the series of sin(t/2)/t."""
    t = norm(r)
    s = F.when(t < tiny, 0.5 - t * t / 48).otherwise(F.sin(t / 2) / F.when(t >= tiny, t))
    return F.array(F.cos(t / 2), *[r[i] * s for i in range(3)])


def quat_matrix(q: Column) -> Column:
    """The rotation matrix of a unit quaternion."""
    w, x, y, z = (q[i] for i in range(4))
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        F.array(2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        F.array(2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )


def mat_vec(m: Column, v: Column) -> Column:
    return F.array(*[dot(m[i], v) for i in range(3)])


def quat_rotate(q: Column, v: Column) -> Column:
    return mat_vec(quat_matrix(q), v)


def quat_angle(p: Column, q: Column) -> Column:
    """Angle between two attitudes, whatever the signs of their quaternions."""
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot(p, q, 4))))


def quat_of_matrix(m: Column) -> Column:
    """The quaternion with w >= 0 of a rotation matrix, from its largest component."""
    e = lambda i, j: m[i][j]
    squares = [1 + e(0, 0) + e(1, 1) + e(2, 2), 1 + e(0, 0) - e(1, 1) - e(2, 2), 1 - e(0, 0) + e(1, 1) - e(2, 2), 1 - e(0, 0) - e(1, 1) + e(2, 2)]
    w = (e(2, 1) - e(1, 2), e(0, 2) - e(2, 0), e(1, 0) - e(0, 1))
    xy, xz, yz = e(0, 1) + e(1, 0), e(0, 2) + e(2, 0), e(1, 2) + e(2, 1)
    rows = [(None, *w), (w[0], None, xy, xz), (w[1], xy, None, yz), (w[2], xz, yz, None)]
    best = F.greatest(*squares)

    def quat(k: int) -> Column:
        s = 2 * F.sqrt(squares[k])
        return F.array(*[s / 4 if x is None else x / s for x in rows[k]])

    q = F.when(squares[0] == best, quat(0)).when(squares[1] == best, quat(1)).when(squares[2] == best, quat(2)).otherwise(quat(3))
    return F.aggregate(F.array(q), F.lit(None).cast("array<double>"), lambda _, p: F.when(p[0] < 0, F.transform(p, lambda x: -x)).otherwise(p))


def rotation_angle(m: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0][0] + m[1][1] + m[2][2] - 1) / 2)))


def is_rotation(m: Column, tolerance: float = 1e-6) -> Column:
    """Rows of length one at right angles, and determinant one."""
    ok = [F.abs(dot(m[i], m[j]) - float(i == j)) <= tolerance for i in range(3) for j in range(i, 3)]
    return reduce(lambda a, b: a & b, ok) & (F.abs(dot(m[0], cross(m[1], m[2])) - 1) <= tolerance)


def euler_matrix(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Rz(yaw) Ry(pitch) Rx(roll), angles in radians."""
    cy, sy, cp, sp, cr, sr = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
    return F.array(
        F.array(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr),
        F.array(sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr),
        F.array(-sp, cp * sr, cp * cr),
    )


def rodrigues(r: Column, tiny: float = 1e-8) -> Column:
    """The rotation matrix of a rotation vector."""
    return quat_matrix(quat_of_vector(r, tiny))


def shortest_arc(a: Column, b: Column) -> Column:
    """The quaternion that turns direction a to b by the least angle; opposite ones turn about an axis at right angles to a."""
    d = dot(a, b) / (norm(a) * norm(b))
    half = F.sqrt(F.greatest(F.lit(0.0), (1 + d) / 2))
    c = cross(a, b)
    k = 2 * half * norm(a) * norm(b)
    # the axis to use for opposite vectors: a crossed with the axis it is farthest from
    other = F.when(F.abs(a[0]) <= 0.6 * norm(a), cross(a, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))).otherwise(cross(a, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))))
    return F.when(d < -1 + 1e-12, F.array(F.lit(0.0), *[other[i] / norm(other) for i in range(3)])).otherwise(F.array(half, *[c[i] / k for i in range(3)]))


def tilt_heading(mag: Column, up: Column) -> Column:
    """Magnetic heading in degrees of the y axis, from a magnetometer and an up vector in device axes."""
    east = cross(mag, up)
    north = cross(up, east)
    return F.pmod(F.degrees(F.atan2(east[1] / norm(east), north[1] / norm(north))), F.lit(360.0))
