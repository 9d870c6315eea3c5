"""Column expressions of periodic geometry. x and y wrap, z never does; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def minimum_image(delta: Column | str, length: Column | float) -> Column:
    """The shortest of a displacement's periodic images."""
    delta = _c(delta)
    return delta - _c(length) * F.rint(delta / _c(length))


def squared_distance(a: tuple, b: tuple, box: tuple[float, float]) -> Column:
    """Squared distance of two points, periodic in x and y; of two components in the plane, of three in space."""
    parts = [minimum_image(_c(p) - _c(q), side) for p, q, side in zip(a[:2], b[:2], box, strict=True)]
    parts += [_c(p) - _c(q) for p, q in zip(a[2:], b[2:], strict=True)]
    out = parts[0] * parts[0]
    for p in parts[1:]:
        out = out + p * p
    return out


def voxel_index(position: Column | str, origin: float, spacing: float, count: int, periodic: bool) -> Column:
    """Index of the voxel that a coordinate lies in; null outside a bounded axis."""
    steps = (_c(position) - origin) / spacing
    at = F.floor(F.pmod(steps, F.lit(float(count))) if periodic else steps)
    at = F.least(at, F.lit(count - 1)) if periodic else at
    return at if periodic else F.when((at >= 0) & (at < count), at)


def flat_index(x: Column | str, y: Column | str, z: Column | str, nx: int, ny: int) -> Column:
    """x runs fastest."""
    return _c(x) + nx * (_c(y) + ny * _c(z))


def dot(a: tuple, b: tuple) -> Column:
    out = _c(a[0]) * _c(b[0])
    for p, q in zip(a[1:], b[1:], strict=True):
        out = out + _c(p) * _c(q)
    return out


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    (ax, ay, az), (bx, by, bz) = map(lambda v: tuple(map(_c, v)), (a, b))
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def norm(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: tuple) -> tuple[Column, ...]:
    n = norm(a)
    return tuple(F.when(n > 0, _c(p) / n) for p in a)


def angle(a: tuple, b: tuple) -> Column:
    """Angle of two directions in radians, safe at the ends of acos."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def rotated(quaternion: tuple, vector: tuple) -> tuple[Column, Column, Column]:
    """A vector turned by a unit quaternion (x, y, z, w)."""
    qx, qy, qz, qw = map(_c, quaternion)
    t = tuple(2 * p for p in cross((qx, qy, qz), vector))
    u = cross((qx, qy, qz), t)
    return tuple(_c(v) + qw * a + b for v, a, b in zip(vector, t, u, strict=True))


def placed(quaternion: tuple, vector: tuple, translation: tuple) -> tuple[Column, Column, Column]:
    """Rigid transform of a template point."""
    return tuple(p + _c(t) for p, t in zip(rotated(quaternion, vector), translation, strict=True))


def normal_plane_axes(tangent: tuple, nearly: float = 0.85) -> tuple[tuple, tuple]:
    """Two unit axes across a unit tangent: from z as the reference, or x where the tangent is near z."""
    near = F.abs(_c(tangent[2])) > nearly
    reference = (F.when(near, 1.0).otherwise(0.0), F.lit(0.0), F.when(near, 0.0).otherwise(1.0))
    first = unit(cross(tangent, reference))
    return first, cross(tangent, first)


def projected_angle(along: Column | str, across: Column | str, other: Column | str, least_fraction: float) -> Column:
    """Angle in degrees of an axis' projection onto the plane (along, across) from `along`, folded into 0..90; null where the projection is short."""
    along, across, other = _c(along), _c(across), _c(other)
    flat = F.sqrt(along * along + across * across)
    whole = F.sqrt(along * along + across * across + other * other)
    return F.when((whole > 0) & (flat / whole >= least_fraction), F.degrees(F.atan2(F.abs(across), F.abs(along))))


def snapped(value: Column | str, low: float, high: float, tolerance: float) -> Column:
    """A coordinate moved onto a face it is within tolerance of, and clipped to the box."""
    value = _c(value)
    near = F.when(F.abs(value - low) <= tolerance, F.lit(low)).when(F.abs(value - high) <= tolerance, F.lit(high)).otherwise(value)
    return F.least(F.greatest(near, F.lit(low)), F.lit(high))


def protrusion(z: Column | str, height: float) -> tuple[Column, Column]:
    """How far a point stands out below and above a film."""
    z = _c(z)
    return F.greatest(-z, F.lit(0.0)), F.greatest(z - height, F.lit(0.0))


def roughness_from_curvature(curvature: Column | str) -> Column:
    return F.least(F.lit(0.25), 0.05 * _c(curvature))


def target_curve(x: Column | str, components: list[dict]) -> Column:
    """1 plus peaks, minus dips and exclusions, times oscillations, never below 0.

    A component: kind (peak, dip, exclusion, oscillation), amplitude, center, width.
    """
    x = _c(x)
    out = F.lit(1.0)
    for c in components:
        u = (x - c["center"]) / c["width"]
        bell = F.exp(-0.5 * u * u) * c["amplitude"]
        if c["kind"] == "oscillation":
            out = out + c["amplitude"] * F.cos(2 * F.pi() * u)
        else:
            out = out + bell if c["kind"] == "peak" else out - bell
    return F.greatest(F.lit(0.0), out)


def slug(text: Column | str) -> Column:
    """Lower case, runs of what is neither letter nor digit as one hyphen, none at the ends."""
    flat = F.regexp_replace(F.lower(F.trim(_c(text))), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(flat, "^-+|-+$", "")


def scaled_unit_columns(scale: float) -> dict[str, Column]:
    """Similarity scaling of a unit table: lengths by s, volumes by s**3, anchors fixed."""
    return {"radius": F.col("radius") * scale, "volume": F.col("volume") * scale**3}
