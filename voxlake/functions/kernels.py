"""Array kernels for one slice, one section or one run at a time, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np


def squared_distances(mask: np.ndarray, periodic: tuple[bool, ...]) -> np.ndarray:
    """Squared distance, in voxels, of every cell to the nearest False one; infinite if there is none.

    Separable: along each axis in turn the least of (earlier distance + squared step), steps around the border where
    the axis is periodic.
    """
    best = np.where(mask, np.inf, 0.0)
    for axis, wraps in enumerate(periodic):
        n = mask.shape[axis]
        step = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
        if wraps:
            step = np.minimum(step, n - step)
        lines = np.moveaxis(best, axis, -1)
        out = np.empty_like(lines)
        square = (step**2).astype(float)
        for i in range(n):
            out[..., i] = (lines + square[i]).min(axis=-1)
        best = np.moveaxis(out, -1, axis)
    return best


def distances(mask: np.ndarray, spacing: float = 1.0, periodic: tuple[bool, ...] | None = None) -> np.ndarray:
    return np.sqrt(squared_distances(mask, periodic or (True,) * mask.ndim)) * spacing


def _neighbourhood_max(x: np.ndarray, reach: int) -> np.ndarray:
    """Largest value in the periodic square of half side `reach` around each cell."""
    out = x
    for axis in (0, 1):
        out = np.max([np.roll(out, s, axis) for s in range(-min(reach, x.shape[axis] - 1), min(reach, x.shape[axis] - 1) + 1)], axis=0)
    return out


def slice_centers(mask: np.ndarray, spacing: float, separation: float, origin: tuple[float, float] = (0.0, 0.0)) -> list[tuple[float, float, float]]:
    """(x, y, wall distance) of the pores of a periodic slice, mask[y, x], in order of x and y.

    Cells that are deepest within the separation are candidates; equal neighbours are one, at their mean. From the
    deepest on, a candidate stands if no accepted one is within the separation; each then moves to the mean of the
    pore cells nearest to it, weighted by their squared depth.
    """
    if not mask.any():
        return []
    ny, nx = mask.shape
    box = np.array([nx * spacing, ny * spacing])
    depth = distances(mask, spacing)
    if not np.isfinite(depth).all():
        return []
    peak = (depth >= _neighbourhood_max(depth, max(1, int(np.ceil(separation / spacing))))) & (depth > 0.5 * spacing)
    ys, xs = np.nonzero(peak)
    if not len(ys):
        return []
    label = np.arange(len(ys))
    place = {(y, x): i for i, (y, x) in enumerate(zip(ys.tolist(), xs.tolist(), strict=True))}
    todo = set(range(len(ys)))
    while todo:  # flood over touching cells of equal depth
        start = min(todo)
        stack = [start]
        todo.discard(start)
        while stack:
            i = stack.pop()
            label[i] = label[start]
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    j = place.get(((int(ys[i]) + dy) % ny, (int(xs[i]) + dx) % nx))
                    if j in todo and np.isclose(depth[ys[i], xs[i]], depth[ys[j], xs[j]], atol=1e-12):
                        todo.discard(j)
                        stack.append(j)
    spot = np.stack([origin[0] + (xs + 0.5) * spacing, origin[1] + (ys + 0.5) * spacing], axis=1)
    found = []
    for g in np.unique(label):
        mine = np.flatnonzero(label == g)
        shift = _image(spot[mine] - spot[mine[0]], box)
        xy = np.mod(spot[mine[0]] + shift.mean(axis=0), box) if len(mine) > 1 else spot[mine[0]]
        found.append((float(depth[ys[mine], xs[mine]].max()), xy))
    found.sort(key=lambda f: (-f[0], f[1][0], f[1][1]))
    kept: list[tuple[float, np.ndarray]] = []
    for wall, xy in found:
        if all(np.hypot(*_image(xy - other, box)) > separation + 1e-12 for _, other in kept):
            kept.append((wall, xy))
    py, px = np.nonzero(mask)
    cells = np.stack([origin[0] + (px + 0.5) * spacing, origin[1] + (py + 0.5) * spacing], axis=1)
    away = np.stack([np.hypot(*_image(cells - xy, box).T) for _, xy in kept])
    nearest = away.argmin(axis=0)
    out = []
    for i, (wall, xy) in enumerate(kept):
        mine = nearest == i
        if mine.any():
            weight = depth[py[mine], px[mine]] ** 2
            weight = weight if weight.any() else np.ones_like(weight)
            xy = np.mod(xy + np.average(_image(cells[mine] - xy, box), axis=0, weights=weight), box)
        out.append((float(xy[0]), float(xy[1]), wall))
    return sorted(out)


def _image(delta: np.ndarray, box: np.ndarray) -> np.ndarray:
    return delta - box * np.rint(delta / box)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of least total cost, each row and column once: shortest augmenting paths with row and column prices."""
    cost = np.asarray(cost, float)
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    if not n:
        return []
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        shortest, via = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        at, came, length = row, -1, 0.0
        while True:
            step = length + c[at] - row_price[at] - column_price
            better = ~done & (step < shortest - 1e-15)
            shortest[better], via[better] = step[better], came
            column = int(np.argmin(np.where(done, np.inf, shortest)))
            length = shortest[column]
            done[column] = True
            came = column
            if owner[column] < 0:
                break
            at = int(owner[column])
        ready = np.flatnonzero(done)
        row_price[row] += length
        for j in ready:
            if owner[j] >= 0 and j != came:
                row_price[owner[j]] += length - shortest[j]
            column_price[j] -= length - shortest[j]
        while came >= 0:
            before = via[came]
            owner[came] = owner[before] if before >= 0 else row
            came = before
    pairs = [(int(r), j) for j, r in enumerate(owner) if r >= 0]
    return sorted((j, r) for r, j in pairs) if turned else sorted(pairs)


def linked_tracks(slices: list[tuple[int, float, list[tuple[float, float, float]]]], box: tuple[float, float], reach: float) -> tuple[list[dict], int]:
    """Points of tracks through consecutive slices (index, z, centres), and the number of branchings.

    Each slice's centres are assigned to the tracks alive in the one before at least total distance; pairs farther
    than `reach` are dropped afterwards. A track that gets no centre has ended; a slice without centres ends all.
    A centre or a track with more than one partner within reach is a branching there.
    """
    side = np.array(box)
    points: list[dict] = []
    last: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # track -> wrapped and unwrapped place
    branched: dict[int, set[float]] = {}
    events, fresh = 0, 0
    for index, z, centers in slices:
        if not centers:
            last = {}
            continue
        now = np.array([c[:2] for c in centers])
        names = sorted(last)
        taken: dict[int, int] = {}
        if names:
            before = np.array([last[t][0] for t in names])
            away = np.hypot(*np.moveaxis(_image(before[:, None] - now[None, :], side), -1, 0))
            close = away <= reach
            forks, joins = np.flatnonzero(close.sum(axis=1) > 1), np.flatnonzero(close.sum(axis=0) > 1)
            events += len(forks) + len(joins)
            for r in {*forks.tolist(), *np.flatnonzero(close[:, joins].any(axis=1)).tolist()}:
                branched.setdefault(names[r], set()).add(z)
            for r, c in assignment(away):
                if away[r, c] <= reach:
                    taken[c] = names[r]
        alive = {}
        for c, (x, y, wall) in enumerate(centers):
            wrapped = np.array([x, y])
            track = taken.get(c)
            if track is None:
                track, fresh = fresh, fresh + 1
                free = wrapped
                if names and close[:, c].any():
                    branched.setdefault(track, set()).add(z)
            else:
                free = last[track][1] + _image(wrapped - last[track][0], side)
            alive[track] = (wrapped, free)
            points.append({"track_id": track, "z_index": index, "x": float(free[0]), "y": float(free[1]), "z": z, "wrapped_x": x, "wrapped_y": y, "wall": wall})
        last = alive
    for p in points:
        p["branch"] = p["z"] in branched.get(p["track_id"], ())
    return points, events


def smoothed(points: np.ndarray) -> np.ndarray:
    """Gaussian of one sample over four either side, ends repeated and kept; short tracks as they are."""
    if len(points) < 4:
        return points.copy()
    weight = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    weight /= weight.sum()
    wide = np.pad(points, ((4, 4), (0, 0)), mode="edge")
    out = sum(w * wide[k : k + len(points)] for k, w in enumerate(weight))
    out[0], out[-1] = points[0], points[-1]
    return out


def trilinear(mask: np.ndarray, at: np.ndarray, spacing: float, origin: np.ndarray) -> np.ndarray:
    """Values of mask[z, y, x] between its cell centres; x and y around the border, nothing outside in z."""
    nz, ny, nx = mask.shape
    u = (at - origin) / spacing - 0.5
    base = np.floor(u).astype(int)
    part = u - base
    out = np.zeros(len(at))
    for dz in (0, 1):
        k = base[:, 2] + dz
        inside = (k >= 0) & (k < nz)
        for dy in (0, 1):
            for dx in (0, 1):
                w = np.abs(1 - dx - part[:, 0]) * np.abs(1 - dy - part[:, 1]) * np.abs(1 - dz - part[:, 2])
                out += np.where(inside, w * mask[np.clip(k, 0, nz - 1), (base[:, 1] + dy) % ny, (base[:, 0] + dx) % nx], 0)
    return out


def component_at(image: np.ndarray, start: tuple[int, int]) -> np.ndarray | None:
    """The 8-connected True region that holds a cell; None if the cell is False. Runs of rows are joined to those they touch in the row before."""
    if not image[start]:
        return None
    edge = np.diff(np.pad(image.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]  # one past the run
    first = np.searchsorted(rows, np.arange(image.shape[0] + 1))
    root = np.arange(len(rows))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for r in range(1, image.shape[0]):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if begin[i] <= end[j] and begin[j] <= end[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    mine = find(next(k for k in range(first[start[0]], first[start[0] + 1]) if begin[k] <= start[1] < end[k]))
    out = np.zeros_like(image)
    for k in range(len(rows)):
        if find(k) == mine:
            out[rows[k], begin[k] : end[k]] = True
    return out


def pore_components(mask: np.ndarray) -> int:
    """Number of face-connected True regions of mask[z, y, x], periodic in y and x: smallest labels pass along links and on to the labels' labels."""
    at = np.cumsum(mask.ravel()).reshape(mask.shape) - 1
    ends = []
    for axis in range(3):
        here = mask & np.roll(mask, -1, axis)
        if axis == 0:
            here[-1] = False
        ends.append(np.stack([at[here], np.roll(at, -1, axis)[here]]))
    a, b = np.concatenate(ends, axis=1)
    root = np.arange(int(mask.sum()))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return len(np.unique(root))


def block_components(mask: np.ndarray) -> np.ndarray:
    """For each True cell of mask[z, y, x], in order, the place of its face-connected region's first True cell; nothing wraps."""
    at = np.cumsum(mask.ravel()).reshape(mask.shape) - 1
    ends = []
    for axis in range(3):
        low, high = (tuple(slice(o, n) if k == axis else slice(None) for k in range(3)) for o, n in ((None, -1), (1, None)))
        both = mask[low] & mask[high]
        ends.append(np.stack([at[low][both], at[high][both]]))
    a, b = np.concatenate(ends, axis=1)
    root = np.arange(int(mask.sum()))
    while (root[a] != root[b]).any():
        first, second = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, second, first)
        while (root[root] != root).any():
            root = root[root]
    return root


def contours(values: np.ndarray, level: float = 0.5) -> list[np.ndarray]:
    """Closed polygons (row, column) around what is over the level; the image is taken to be low outside.

    Marching squares: each edge of the grid whose ends lie on different sides is crossed once; within a square the
    crossings are joined so that the high corners stay to one side, two high corners across from each other apart.
    """
    v = np.asarray(values, float)
    low = v.min() if v.size and v.min() < level else level - 1
    v = np.pad(v, 1, constant_values=low)
    high = v > level
    follow: dict[tuple, tuple] = {}
    corner = ((0, 0), (0, 1), (1, 1), (1, 0))
    squares = high[:-1, :-1].astype(int) + high[:-1, 1:] + high[1:, 1:] + high[1:, :-1]
    for i, j in np.argwhere((squares > 0) & (squares < 4)).tolist():
        on = [bool(high[i + a, j + b]) for a, b in corner]
        # around the square: an edge from low to high enters the high part, the next from high to low leaves it
        enter = [k for k in range(4) if not on[k] and on[(k + 1) % 4]]
        for k in enter:
            m = (k + 1) % 4
            while on[(m + 1) % 4]:
                m = (m + 1) % 4
            name = lambda e: tuple(sorted(((i + corner[e][0], j + corner[e][1]), (i + corner[(e + 1) % 4][0], j + corner[(e + 1) % 4][1]))))  # noqa: E731, B023
            follow[name(k)] = name(m)
    out = []
    while follow:
        first = next(iter(follow))
        ring, at = [], first
        while at in follow:
            ring.append(at)
            at = follow.pop(at)
        points = []
        for p, q in ring:
            t = (level - v[p]) / (v[q] - v[p])
            points.append((p[0] + t * (q[0] - p[0]) - 1, p[1] + t * (q[1] - p[1]) - 1))
        out.append(np.array(points))
    return out


def polygon_area(points: np.ndarray) -> float:
    after = np.roll(points, -1, axis=0)
    return float((points[:, 0] * after[:, 1] - points[:, 1] * after[:, 0]).sum() / 2)


def curvature_fluctuation(points: np.ndarray, spacing: float, smoothing: float) -> float:
    """Population deviation over mean of the signed curvature of a closed curve, resampled evenly and smoothed around."""
    closed = np.concatenate([points, points[:1]])
    size = np.hypot(*np.diff(closed, axis=0).T)
    whole = size.sum()
    if whole <= 0:
        return float("nan")
    arc = np.concatenate([[0], np.cumsum(size)])
    n = max(16, int(np.ceil(whole / spacing)))
    s = np.arange(n) * whole / n
    xy = np.stack([np.interp(s, arc, closed[:, k]) for k in (0, 1)], axis=1)
    sigma = smoothing / max(spacing, 1e-12)
    if sigma > 0:
        reach = int(4 * sigma + 0.5)
        weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        xy = sum(w * np.roll(xy, -k, axis=0) for k, w in zip(range(-reach, reach + 1), weight / weight.sum(), strict=True))
    h = whole / n
    a, b = np.roll(xy, -1, axis=0), np.roll(xy, 1, axis=0)
    d, dd = (a - b) / (2 * h), (a - 2 * xy + b) / h**2
    kappa = (d[:, 0] * dd[:, 1] - d[:, 1] * dd[:, 0]) / np.maximum((d**2).sum(axis=1) ** 1.5, 1e-12)
    return float(kappa.std() / max(abs(kappa.mean()), 1e-12))


def normal_section(mask: np.ndarray, center: np.ndarray, tangent: np.ndarray, wall: float, contract: dict, spacing: float, origin: np.ndarray) -> dict:
    """Area, equal-area diameter and curvature fluctuation of the pore across `tangent`, or why there is none."""
    tangent = tangent / np.linalg.norm(tangent)
    reference = np.array([1.0, 0, 0]) if abs(tangent[2]) > 0.85 else np.array([0, 0, 1.0])
    first = np.cross(tangent, reference)
    first /= np.linalg.norm(first)
    second = np.cross(tangent, first)
    step = max(min(spacing / 2, contract["boundary_resample_spacing_A"]), spacing / 4)
    nz, ny, nx = mask.shape
    most = 0.75 * np.linalg.norm([nx * spacing, ny * spacing, nz * spacing])
    extent = min(max(3 * wall, 4 * spacing, 2 * contract["center_min_separation_A"]), most)
    for _ in range(4):
        half = int(np.ceil(extent / step))
        grid = np.arange(-half, half + 1) * step
        at = center + grid[:, None, None] * first + grid[None, :, None] * second
        image = trilinear(mask, at.reshape(-1, 3), spacing, origin).reshape(len(grid), len(grid))
        region = component_at(image >= 0.5, (half, half))
        if region is None:
            return {"valid": False, "invalid_reason": "center_not_in_pore"}
        if not (region[0].any() or region[-1].any() or region[:, 0].any() or region[:, -1].any()):
            rings = [r for r in contours(region.astype(float)) if len(r) >= 8]
            if not rings:
                return {"valid": False, "invalid_reason": "boundary_not_found"}
            ring = max(rings, key=len) * step
            area = abs(polygon_area(ring))
            if area <= 0:
                return {"valid": False, "invalid_reason": "nonpositive_area"}
            return {
                "valid": True,
                "invalid_reason": None,
                "area": area,
                "diameter": 2 * np.sqrt(area / np.pi),
                "fluctuation": curvature_fluctuation(ring, contract["boundary_resample_spacing_A"], contract["curvature_smoothing_length_A"]),
            }
        if extent >= most:
            break
        extent = min(1.75 * extent, most)
    return {"valid": False, "invalid_reason": "cross_section_not_bounded"}


def local_thickness(mask: np.ndarray, spacing: float = 1.0, periodic: tuple[bool, bool, bool] = (False, True, True)) -> np.ndarray:
    """At each True cell the diameter of the largest ball that fits in and covers it: every cell is a centre, the largest first."""
    square = squared_distances(mask, periodic)
    out = np.zeros(mask.shape)
    for r2 in np.unique(square[mask & np.isfinite(square)])[::-1]:
        seeds = mask & (square == r2)
        reach = squared_distances(~seeds, periodic)  # of every cell to the nearest centre of this size
        hit = mask & (reach < r2) & (out == 0)
        out[hit] = 2 * np.sqrt(r2) * spacing
    return out


#: Six tetrahedra around the main diagonal of a cube, by corner number (x + 2 y + 4 z).
TETRAHEDRA = ((0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7))


_CORNER = np.array([(k & 1, k >> 1 & 1, k >> 2) for k in range(8)])


@cache
def _cut_cube(case: int) -> np.ndarray:
    """(triangles, 3, 3): where the surface crosses a cube whose corner k is inside if bit k is set, as sums of the two corners of the edges it crosses in the middle, seen anticlockwise from outside."""
    out = []
    for tet in TETRAHEDRA:
        on, off = [k for k in tet if case >> k & 1], [k for k in tet if not case >> k & 1]
        if not on or not off:
            continue
        cut = lambda a, b: _CORNER[a] + _CORNER[b]
        if len(on) == 2:
            q = [cut(on[0], off[0]), cut(on[0], off[1]), cut(on[1], off[1]), cut(on[1], off[0])]
            made = [(q[0], q[1], q[2]), (q[0], q[2], q[3])]
        else:
            one, rest = (on[0], off) if len(on) == 1 else (off[0], on)
            made = [tuple(cut(one, r) for r in rest)]
        outward = _CORNER[off].mean(axis=0) - _CORNER[on].mean(axis=0)
        for t in made:
            turned = np.cross(t[1] - t[0], t[2] - t[0]) @ outward < 0
            out.append([t[0], t[2], t[1]] if turned else list(t))
    return np.array(out, np.int64).reshape(-1, 3, 3)


def surface_triangles(inside: np.ndarray) -> np.ndarray:
    """(triangles, corners, xyz) of the surface between inside[z, y, x] and the rest, in twice the array's places."""
    nz, ny, nx = inside.shape
    case = np.zeros((max(0, nz - 1), max(0, ny - 1), max(0, nx - 1)), np.int64)
    for k, (x, y, z) in enumerate(_CORNER.tolist()):
        case |= inside[z : nz - 1 + z, y : ny - 1 + y, x : nx - 1 + x].astype(np.int64) << k
    out = [np.zeros((0, 3, 3), np.int64)]
    for c in np.unique(case).tolist():
        shape = _cut_cube(c)
        if len(shape):
            at = 2 * np.argwhere(case == c)[:, ::-1]
            out.append((at[:, None, None, :] + shape[None]).reshape(-1, 3, 3))
    return np.concatenate(out)


def surface(mask: np.ndarray, spacing: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(vertices xyz, faces) of the closed surface around the True cells: each cube of cell centres is cut into tetrahedra, each of which is crossed in a triangle or two.

    Vertices lie in the middle of the edges they cross, are shared, and moved onto the outer faces of the box.
    """
    found = surface_triangles(np.pad(mask, 1))
    vertices, faces = np.unique(found.reshape(-1, 3), axis=0, return_inverse=True)
    place = np.clip(vertices / 2 - 0.5, 0, np.array(mask.shape[::-1], float))
    return place * spacing, faces.reshape(-1, 3)


def mesh_volume(vertices: np.ndarray, faces: np.ndarray) -> float:
    a, b, c = (vertices[faces[:, k]] for k in range(3))
    return float((a * np.cross(b, c)).sum() / 6)


def inside_mesh(vertices: np.ndarray, faces: np.ndarray, points: np.ndarray, direction: tuple = (0.8017, 0.2673, 0.5345)) -> np.ndarray:
    """Whether a ray from each point crosses the surface an odd number of times."""
    d = np.array(direction) / np.linalg.norm(direction)
    a, e1, e2 = vertices[faces[:, 0]], vertices[faces[:, 1]] - vertices[faces[:, 0]], vertices[faces[:, 2]] - vertices[faces[:, 0]]
    h = np.cross(d, e2)
    det = (e1 * h).sum(axis=1)
    ok = np.abs(det) > 1e-14
    inv = np.where(ok, 1 / np.where(ok, det, 1), 0)
    out = np.zeros(len(points), bool)
    for i in range(0, len(points), 512):
        s = points[i : i + 512, None] - a[None]
        u = (s * h).sum(axis=2) * inv
        q = np.cross(s, e1)
        v = (q @ d) * inv
        t = (q * e2).sum(axis=2) * inv
        out[i : i + 512] = (ok & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > 1e-12)).sum(axis=1) % 2 == 1
    return out


def kabsch_rmsd(a: np.ndarray, b: np.ndarray) -> float:
    """Least root mean square distance of two point sets under a rigid motion without reflection."""
    x, y = a - a.mean(axis=0), b - b.mean(axis=0)
    u, _, vt = np.linalg.svd(x.T @ y)
    turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
    return float(np.sqrt(((x @ (u @ turn @ vt) - y) ** 2).sum(axis=1).mean()))


def nonplanarity(points: np.ndarray) -> float:
    """Smallest over largest singular value of the centred points."""
    s = np.linalg.svd(points - points.mean(axis=0), compute_uv=False)
    return float(s[-1] / s[0]) if len(s) == 3 and s[0] > 0 else 0.0


def segment_distance(p0: np.ndarray, p1: np.ndarray, q0: np.ndarray, q1: np.ndarray) -> float:
    """Distance of two line segments: inside both, or at an end of one."""
    u, v, w = p1 - p0, q1 - q0, p0 - q0
    a, b, c, d, e = u @ u, u @ v, v @ v, u @ w, v @ w
    tries = []
    det = a * c - b * b
    if det > 1e-14 * max(a * c, 1e-300):
        s, t = (b * e - c * d) / det, (a * e - b * d) / det
        if 0 <= s <= 1 and 0 <= t <= 1:
            tries.append(np.linalg.norm(w + s * u - t * v))
    for s in (0.0, 1.0):
        t = np.clip(((w + s * u) @ v) / c, 0, 1) if c > 0 else 0.0
        tries.append(np.linalg.norm(w + s * u - t * v))
    for t in (0.0, 1.0):
        s = np.clip((t * v - w) @ u / a, 0, 1) if a > 0 else 0.0
        tries.append(np.linalg.norm(w + s * u - t * v))
    return float(min(tries))


def self_clearance(points: np.ndarray, radius: np.ndarray) -> float:
    """Least distance between the surfaces of segments of a tube that lie more than three radii apart along it."""
    size = np.linalg.norm(np.diff(points, axis=0), axis=1)
    arc = np.concatenate([[0], np.cumsum(size)])
    best = np.inf
    for i in range(len(size)):
        for j in range(i + 2, len(size)):
            thick = max(radius[i], radius[i + 1]) + max(radius[j], radius[j + 1])
            if arc[j] - arc[i + 1] > 3 * float(radius.max()):
                best = min(best, segment_distance(points[i], points[i + 1], points[j], points[j + 1]) - thick)
    return float(best)


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Interpolating cubic spline whose third derivative doesn't jump at the second and the last but one knot."""
    n = len(x)
    if n < 3:
        return np.stack([np.interp(at, x, y[:, k]) for k in range(y.shape[1])], axis=1)
    h = np.diff(x)
    slope = np.diff(y, axis=0) / h[:, None]
    if n == 3:  # one parabola
        second = (slope[1] - slope[0]) / (x[2] - x[0])
        return y[0] + slope[0] * (at - x[0])[:, None] + second * ((at - x[0]) * (at - x[1]))[:, None]
    m = np.zeros((n, n))
    r = np.zeros((n, y.shape[1]))
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * (slope[i] - slope[i - 1])
    m[0, :3] = h[1], -(h[0] + h[1]), h[0]
    m[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    c = np.linalg.solve(m, r)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = (x[k + 1] - at)[:, None], (at - x[k])[:, None]
    d = h[k][:, None]
    return c[k] * a**3 / (6 * d) + c[k + 1] * b**3 / (6 * d) + (y[k] / d - c[k] * d / 6) * a + (y[k + 1] / d - c[k + 1] * d / 6) * b


#: Degree, coefficients and initial numbers of each Sobol dimension after the first.
SOBOL_START = [(1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3])]
SOBOL_BITS = 30


def sobol_directions(d: int) -> list[int]:
    """The direction numbers of a dimension, from the lowest bit of the Gray code on."""
    if d == 0:
        return [1 << (SOBOL_BITS - 1 - i) for i in range(SOBOL_BITS)]
    s, a, first = SOBOL_START[d - 1]
    m = list(first)
    for i in range(s, SOBOL_BITS):
        x = m[i - s] ^ (m[i - s] << s)
        for k in range(1, s):
            x ^= (a >> (s - 1 - k) & 1) * (m[i - k] << k)
        m.append(x)
    return [m[i] << (SOBOL_BITS - 1 - i) for i in range(SOBOL_BITS)]


def sobol(n: int, dims: int) -> np.ndarray:
    """The first n points of the unscrambled Sobol sequence in up to six dimensions, by Gray code."""
    out = np.zeros((n, dims))
    index = np.arange(n, dtype=np.int64)
    gray = index ^ (index >> 1)
    for d in range(dims):
        value = np.zeros(n, np.int64)
        for i, v in enumerate(sobol_directions(d)):
            value ^= np.where(gray >> i & 1, v, 0)
        out[:, d] = value / (1 << SOBOL_BITS)
    return out
