"""Random shapes from a seed, and the checks that re-derive what a shape's record claims."""

from __future__ import annotations

import math

import numpy as np

from voxlake.functions import kernels as K
from voxlake.functions.fields import Channel, Compact

#: Limits a shape must keep: envelope fill of lobes, spread and range of a channel's radius, share by which volumes may be off.
FILL, SPREAD, RADIUS, VOLUME = (0.50, 0.85), (0.15, 0.30), (0.60, 1.45), 0.03
ATTEMPTS, SAMPLES = 16, 1 << 15


def lobes_connected(centers: np.ndarray, radii: np.ndarray) -> bool:
    """Whether overlaps, of the lobes' mean radii, link all lobes."""
    n = len(centers)
    size = np.asarray(radii, float).reshape(n, -1).mean(axis=1)
    near = np.linalg.norm(centers[:, None] - centers[None], axis=2) < size[:, None] + size[None]
    reach = np.zeros(n, bool)
    reach[0] = True
    for _ in range(n):
        reach |= near[reach].any(axis=0)
    return bool(reach.all())


def principal_axes(centers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Points turned so that their weighted spread is largest along z and least along x."""
    shift = centers - np.average(centers, axis=0, weights=weights)
    _, axes = np.linalg.eigh((shift * weights[:, None]).T @ shift)
    if np.linalg.det(axes) < 0:
        axes[:, 0] *= -1
    return shift @ axes


def envelope(unit: Compact) -> np.ndarray:
    """Half extents of a lobed body along its axes, by bisection for the zero of the field beyond each side."""
    out = np.zeros(3)
    far = float(np.abs(unit.lobes).max() + np.max(unit.lobe_radii) * 2)
    grid = np.linspace(-1, 1, 9)
    for axis in range(3):
        others = [k for k in range(3) if k != axis]
        u, v = np.meshgrid(grid, grid)
        base = np.zeros((u.size, 3))
        base[:, others[0]], base[:, others[1]] = u.ravel() * far / 2, v.ravel() * far / 2
        base = np.concatenate([base, unit.lobes])
        for side in (-1.0, 1.0):
            low, high = np.zeros(len(base)), np.full(len(base), far)
            for _ in range(40):
                mid = (low + high) / 2
                points = base.copy()
                points[:, axis] = side * mid
                inside = unit.field(points + unit.center) < 0
                low, high = np.where(inside, mid, low), np.where(inside, high, mid)
            out[axis] = max(out[axis], float(low.max()))
    return out


def sampled_volume(unit: Compact, half: np.ndarray, n: int = SAMPLES) -> float:
    """Volume by the share of Sobol points of the envelope's box that are inside."""
    points = (2 * K.sobol(n, 3) - 1) * half
    return float((unit.field(points + unit.center) < 0).mean() * 8 * np.prod(half))


def lobed(unit_id: str, volume: float, aspect: float, seed: int) -> Compact:
    """Three or four overlapping ellipsoids of a volume; tried again, up to ATTEMPTS times, until they hang together and fill their envelope."""
    rng = np.random.default_rng(seed)
    for _ in range(ATTEMPTS):
        n = int(rng.integers(3, 5))
        radii = rng.uniform(0.75, 1.1, (n, 1)) * rng.uniform(0.85, 1.15, (n, 3))
        centers = [np.zeros(3)]
        for i in range(1, n):
            way = rng.normal(size=3)
            way[2] *= aspect
            parent = int(rng.integers(0, i))
            centers.append(centers[parent] + way / np.linalg.norm(way) * rng.uniform(0.6, 0.9) * (radii[parent].mean() + radii[i].mean()) * 0.75)
        placed = principal_axes(np.array(centers), radii.prod(axis=1))
        unit = Compact(unit_id, np.zeros(3), radii.max(axis=0), lobes=placed, lobe_radii=radii, blend=0.1 * float(radii.min()))
        half = envelope(unit)
        got = sampled_volume(unit, half)
        fill = got / (4 / 3 * math.pi * float(np.prod(half)))
        if got > 0 and lobes_connected(placed, radii) and FILL[0] <= fill <= FILL[1]:
            s = (volume / got) ** (1 / 3)
            return Compact(unit_id, np.zeros(3), radii.max(axis=0) * s, lobes=placed * s, lobe_radii=radii * s, blend=unit.blend * s)
    raise ValueError("no lobed shape within its limits")


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A cubic through the points that doesn't overshoot them: slopes are weighted harmonic means of the neighbours', 0 at turns."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        a, b = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = d[:-1] * d[1:] > 0
        m[1:-1][same] = ((a + b) / (a / np.where(d[:-1] == 0, 1, d[:-1]) + b / np.where(d[1:] == 0, 1, d[1:])))[same]
        for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
            slope = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            m[end] = 0 if slope * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(slope) > 3 * abs(d0) else slope
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    return y[k] * (1 + 2 * t) * (1 - t) ** 2 + m[k] * h[k] * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) + m[k + 1] * h[k] * t * t * (t - 1)


def bent_line(chord: float, arc: float, rng: np.random.Generator, controls: int = 5, n: int = 33) -> np.ndarray:
    """A curve of a chord and an arc length: random sideways control points, scaled by bisection until the spline is long enough."""
    if arc < chord:
        raise ValueError("a curve isn't shorter than its chord")
    s = np.linspace(0, 1, controls)
    side = rng.normal(size=(controls, 2))
    side[[0, -1]] = 0
    fine = np.linspace(0, 1, n)

    def line(amount: float) -> np.ndarray:
        return K.cubic_spline(s, np.column_stack([s * chord, side * amount]), fine)

    length = lambda p: float(np.linalg.norm(np.diff(p, axis=0), axis=1).sum())
    low, high = 0.0, chord
    while length(line(high)) < arc:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if length(line(mid)) < arc else (low, mid)
    return line((low + high) / 2)


def winding(unit_id: str, volume: float, eta: float, tau: float, seed: int) -> Channel:
    """A bent tube of a volume, length over diameter eta and arc over chord tau, whose radius varies within its limits."""
    rng = np.random.default_rng(seed)
    diameter = (4 * volume / (math.pi * eta)) ** (1 / 3)
    for _ in range(ATTEMPTS):
        knots = np.linspace(0, 1, 7)
        radius = monotone_cubic(knots, 1 + 0.32 * rng.uniform(-1, 1, 7), np.linspace(0, 1, 33))
        radius /= radius.mean()
        spread = radius.std() / radius.mean()
        if not (SPREAD[0] <= spread <= SPREAD[1] and RADIUS[0] <= radius.min() and radius.max() <= RADIUS[1]):
            continue
        points = bent_line(diameter * eta / tau, diameter * eta, rng)
        points = points - points.mean(axis=0)
        tube = Channel(unit_id, points, radius * diameter / 2)
        s = math.sqrt(volume / tube.volume())
        tube = Channel(unit_id, points, tube.radius * s)
        if K.self_clearance(tube.points, tube.radius) > 0:
            return tube
    raise ValueError("no channel shape within its limits")


def radius_record(tube: Channel) -> dict:
    """What a channel's record claims: spread and range of the radius, bends, nonplanarity and clearance."""
    way = np.diff(tube.points, axis=0) / tube.size[:, None]
    turn = np.arccos(np.clip((way[1:] * way[:-1]).sum(axis=1), -1, 1))
    return {"radius_cv": float(tube.radius.std() / tube.radius.mean()), "radius_ratio": float(tube.radius.min() / tube.radius.max()), "bend_count": int((turn > 0.08).sum()), "nonplanarity": K.nonplanarity(tube.points), "self_clearance": K.self_clearance(tube.points, tube.radius)}


def shape_issues(record: dict, tube: Channel | None = None, body: Compact | None = None) -> list[str]:
    """What of a unit's record its geometry doesn't bear out."""
    out = []
    volume = tube.volume() if tube is not None else sampled_volume(body, envelope(body))
    if abs(volume - record["volume"]) > VOLUME * record["volume"]:
        out.append(f"volume: {volume:.6g} against {record['volume']:.6g}")
    if tube is not None:
        found = radius_record(tube)
        if not SPREAD[0] <= found["radius_cv"] <= SPREAD[1]:
            out.append(f"radius_cv out of its limits: {found['radius_cv']:.4g}")
        for name, value in found.items():
            if name in record and abs(record[name] - value) > 1e-6 * max(1, abs(value)):
                out.append(f"{name}: {value:.6g} against {record[name]:.6g}")
        if found["self_clearance"] <= 0:
            out.append("the channel meets itself")
    if body is not None and body.lobes is not None and not lobes_connected(body.lobes, body.lobe_radii):
        out.append("lobes apart")
    return out


def nearest_on_mesh(vertices: np.ndarray, faces: np.ndarray, points: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of a surface to each point, and its distance. Any number of both, in blocks; refuses more than `most` point-face pairs if that is given."""
    if most is not None and len(points) * len(faces) > most:
        raise ValueError(f"{len(points)} points by {len(faces)} faces are over {most}")
    best, where = np.full(len(points), np.inf), np.zeros((len(points), 3))
    for first in range(0, len(faces), 4096):
        a, b, c = (vertices[faces[first : first + 4096, k]] for k in range(3))
        for i in range(0, len(points), 256):
            p = points[i : i + 256, None]
            candidates = []
            for u, v in ((a, b), (b, c), (c, a)):
                edge = v - u
                t = np.clip(((p - u) * edge).sum(2) / np.maximum((edge * edge).sum(1), 1e-300), 0, 1)
                candidates.append(u + t[..., None] * edge)
            normal = np.cross(b - a, c - a)
            square = np.maximum((normal * normal).sum(1), 1e-300)
            flat = p - (((p - a) * normal).sum(2) / square)[..., None] * normal
            inside = np.ones(flat.shape[:2], bool)
            for u, v in ((a, b), (b, c), (c, a)):
                inside &= (np.cross(v - u, flat - u) * normal).sum(2) >= 0
            candidates.append(np.where(inside[..., None], flat, candidates[0]))
            for q in candidates:
                d = np.linalg.norm(q - p, axis=2)
                k = d.argmin(axis=1)
                row = np.arange(len(k))
                closer = d[row, k] < best[i : i + 256]
                where[i : i + 256][closer] = q[row, k][closer]
                best[i : i + 256] = np.minimum(best[i : i + 256], d[row, k])
    return where, best
