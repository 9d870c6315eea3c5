"""Files out of tables and back: molecule files, meshes, JSON and CSV tables, checksums, run folders, reports.

Tables are written by Spark. Formats that are one stream of bytes (a mesh, a report, a molecule file for another
program) are written by the driver from tables of a stated, bounded size.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import struct
from pathlib import Path
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import kernels as K


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """serial and line: HETATM records of atoms(serial, name, residue, chain, residue_no, x, y, z, element)."""
    line = F.format_string("HETATM%5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.col("serial") % 100000, "name", "residue", "chain", F.col("residue_no") % 10000, "x", "y", "z", "element")
    return atoms.select("serial", line.alias("value"))


def cif_lines(atoms: DataFrame) -> DataFrame:
    line = F.format_string("HETATM %d %s %s %s %s %d %.3f %.3f %.3f", "serial", "element", "name", "residue", "chain", "residue_no", "x", "y", "z")
    return atoms.select("serial", line.alias("value"))


#: The columns of an mmCIF atom table in the order of cif_lines.
CIF_COLUMNS = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z"]


def instance_rows(instances: DataFrame, quaternion: str = "xyzw") -> DataFrame:
    """instance, translation and rotation, the quaternion's real part last (xyzw) or first (wxyz)."""
    order = [f"q{c}" for c in quaternion]
    return instances.select("instance", "x", "y", "z", *order)


def write_text(lines: DataFrame, path: str, order: str) -> None:
    """Lines in order as text parts whose names are in that order: one after another they are the file, and no task writes all of it."""
    lines.orderBy(order).select("value").write.mode("overwrite").text(path)


def fixed_decimals(columns: list[str], digits: int = 10) -> list[Column]:
    """Numbers as text with that many decimals, null as nothing."""
    return [F.coalesce(F.format_string(f"%.{digits}f", F.col(c).cast("double")), F.lit("")).alias(c) for c in columns]


def sorted_json(df: DataFrame) -> Column:
    """A row as JSON with its keys in order."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def checksums(spark: SparkSession, folder: str, manifest: str = "checksums.sha256") -> DataFrame:
    """sha and relative path of every file in a folder but the manifest, by path; read and hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = re.sub(r"^file:/*", "/", folder).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(root)}/", "")
    return files.select(F.sha2("content", 256).alias("sha"), relative.alias("relative")).where(F.col("relative") != manifest).orderBy("relative")


def array_sha256(values: np.ndarray) -> str:
    """Of an array's shape, type and bytes."""
    values = np.ascontiguousarray(values)
    return hashlib.sha256(f"{values.dtype.str}{values.shape}".encode() + values.tobytes()).hexdigest()


def glb(vertices: np.ndarray, faces: np.ndarray, metadata: dict | None = None) -> bytes:
    """A binary glTF scene of one mesh with a plain material."""
    points, index = vertices.astype("<f4"), faces.astype("<u4")
    body = points.tobytes() + index.tobytes()
    scene = {
        "asset": {"version": "2.0"},
        "scene": 0,
        "scenes": [{"nodes": [0], "extras": metadata or {}}],
        "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "material": 0}]}],
        "materials": [{"pbrMetallicRoughness": {"baseColorFactor": [0.35, 0.45, 0.6, 1.0], "metallicFactor": 0.1, "roughnessFactor": 0.8}}],
        "buffers": [{"byteLength": len(body)}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": points.nbytes, "target": 34962}, {"buffer": 0, "byteOffset": points.nbytes, "byteLength": index.nbytes, "target": 34963}],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "count": len(points), "type": "VEC3", "min": points.min(axis=0).tolist() if len(points) else [0, 0, 0], "max": points.max(axis=0).tolist() if len(points) else [0, 0, 0]},
            {"bufferView": 1, "componentType": 5125, "count": index.size, "type": "SCALAR"},
        ],
    }
    text = json.dumps(scene, sort_keys=True).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    chunks = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(body), 0x004E4942) + body
    return struct.pack("<III", 0x46546C67, 2, 12 + len(chunks)) + chunks


def _matrix(node: dict) -> np.ndarray:
    """A node's transform: its matrix, or translation times rotation times scale."""
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T  # stored by column
    out = np.eye(4)
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), float)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def placed_meshes(scene: dict) -> list[tuple[int, np.ndarray]]:
    """(mesh, transform) of every node of the scene shown that has a mesh, transforms composed from the root down; all meshes as they are if there are no nodes."""
    nodes = scene.get("nodes", [])
    if not nodes:
        return [(i, np.eye(4)) for i in range(len(scene.get("meshes", [])))]
    scenes = scene.get("scenes", [])
    children = {c for n in nodes for c in n.get("children", [])}
    roots = scenes[scene.get("scene", 0)].get("nodes", []) if scenes else [i for i in range(len(nodes)) if i not in children]
    out, open_ = [], [(i, np.eye(4), frozenset()) for i in reversed(roots)]
    while open_:
        i, above, path = open_.pop()
        if i in path:
            raise ValueError("a node is its own descendant")
        here = above @ _matrix(nodes[i])
        if "mesh" in nodes[i]:
            out.append((nodes[i]["mesh"], here))
        open_ += [(c, here, path | {i}) for c in reversed(nodes[i].get("children", []))]
    return out


def read_glb(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All triangles of a binary glTF file's scene as one mesh, each where its nodes put it; mirrored ones keep facing outwards.

    Strips and fans are triangles too; points and lines are left out. Interleaved and normalised accessors are read as they are laid out, sparse ones refused.
    """
    magic, version, _ = struct.unpack_from("<III", raw)
    if magic != 0x46546C67 or version != 2:
        raise ValueError("no binary glTF of version 2")
    at, chunks = 12, {}
    while at < len(raw):
        size, kind = struct.unpack_from("<II", raw, at)
        chunks[kind] = raw[at + 8 : at + 8 + size]
        at += 8 + size
    scene, body = json.loads(chunks[0x4E4F534A]), chunks.get(0x004E4942, b"")
    kinds, width = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}, {"SCALAR": 1, "VEC3": 3}

    def accessor(i: int) -> np.ndarray:
        a = scene["accessors"][i]
        if "sparse" in a:
            raise ValueError("sparse accessors aren't read")
        kind, n = np.dtype(kinds[a["componentType"]]), width[a["type"]]
        if "bufferView" not in a:
            return np.zeros((a["count"], n), kind)
        view = scene["bufferViews"][a["bufferView"]]
        start, stride = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride") or n * kind.itemsize
        if a["count"] and start + stride * (a["count"] - 1) + n * kind.itemsize > len(body):
            raise ValueError("an accessor goes beyond its buffer")
        values = np.ndarray((a["count"], n), kind, body, start, (stride, kind.itemsize))
        return values / np.iinfo(kind).max if a.get("normalized") and kind.kind in "iu" else values

    points, faces, base = [np.zeros((0, 3))], [np.zeros((0, 3), int)], 0
    for mesh, transform in placed_meshes(scene):
        for p in scene["meshes"][mesh]["primitives"]:
            mode = p.get("mode", 4)
            if mode < 4 or "POSITION" not in p["attributes"]:
                continue
            v = accessor(p["attributes"]["POSITION"]).astype(float)
            i = accessor(p["indices"]).ravel().astype(int) if "indices" in p else np.arange(len(v))
            k = np.arange(max(0, len(i) - 2))
            f = i[: len(i) // 3 * 3].reshape(-1, 3) if mode == 4 else np.stack([i[k + k % 2], i[k + 1 - k % 2], i[k + 2]], axis=1) if mode == 5 else np.stack([np.broadcast_to(i[:1], len(k)), i[k + 1], i[k + 2]], axis=1)
            points.append(v @ transform[:3, :3].T + transform[:3, 3])
            faces.append((f[:, ::-1] if np.linalg.det(transform[:3, :3]) < 0 else f) + base)
            base += len(v)
    return np.concatenate(points), np.concatenate(faces)


def scene_triangles(spark: SparkSession, path: str) -> DataFrame:
    """file, face and corners x1 .. z3 (see operators.mesh) of binary glTF files, and error, for a file that can't be read, in a row of its own; a file is a task's."""
    from voxlake.operators.mesh import CORNERS

    def run(frames):
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    v, f = read_glb(bytes(raw))
                    out = pd.DataFrame(v[f].reshape(-1, 9), columns=CORNERS)
                    yield pd.concat([pd.DataFrame({"file": name, "face": np.arange(len(f))}), out, pd.DataFrame({"error": pd.Series([None] * len(f), dtype=object)})], axis=1)
                except (ValueError, KeyError, IndexError, TypeError, struct.error) as e:
                    yield pd.DataFrame([{"file": name, "face": None, **dict.fromkeys(CORNERS), "error": f"{type(e).__name__}: {e}"}]).astype({"face": "Int64", **dict.fromkeys(CORNERS, float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, face bigint, " + ", ".join(f"{c} double" for c in CORNERS) + ", error string")


def ply(vertices: np.ndarray, faces: np.ndarray) -> str:
    head = ["ply", "format ascii 1.0", f"element vertex {len(vertices)}", *[f"property float {c}" for c in "xyz"], f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
    return "\n".join([*head, *[" ".join(f"{x:.6f}" for x in v) for v in vertices], *[f"3 {a} {b} {c}" for a, b, c in faces]]) + "\n"


def cleaned_mesh(vertices: np.ndarray, faces: np.ndarray, digits: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Vertices at one place merged, faces without area and repeated ones dropped, vertices without faces too."""
    places, index = np.unique(np.round(vertices, digits), axis=0, return_inverse=True)
    faces = index.ravel()[faces]
    faces = faces[(faces[:, 0] != faces[:, 1]) & (faces[:, 1] != faces[:, 2]) & (faces[:, 0] != faces[:, 2])]
    _, first = np.unique(np.sort(faces, axis=1), axis=0, return_index=True)
    faces = faces[np.sort(first)]
    used, new = np.unique(faces, return_inverse=True)
    return places[used], new.reshape(-1, 3)


def mesh_occupancy_mismatch(vertices: np.ndarray, faces: np.ndarray, mask: np.ndarray, spacing: float, most: int = 8192) -> float:
    """Share of evenly spaced voxels (at most 8192) whose side of the surface isn't what the mask says."""
    n = mask.size
    at = np.unique(np.floor(np.arange(most) * (n - 1) / max(1, most - 1)).astype(int)) if n > most else np.arange(n)
    nz, ny, nx = mask.shape
    centre = (np.stack([at % nx, at // nx % ny, at // (nx * ny)], axis=1) + 0.5) * spacing
    return float((K.inside_mesh(vertices, faces, centre) != mask.ravel()[at]).mean())


def slugged(name: str) -> str:
    return re.sub(r"[\W_]+", "-", name.strip().lower()).strip("-") or "task"


#: Folders of a run.
RUN_FOLDERS = ["input", "geometry", "analysis", "visual", "molecules", "qa_export", "logs"]


def run_folder(root: str, name: str, now: datetime.datetime) -> Path:
    """A new folder for a run: date in Shanghai, name, -02 and on if taken; with its parts."""
    day = now.astimezone(ZoneInfo("Asia/Shanghai")).strftime("%Y-%m-%d")
    base = Path(root) / f"{day}-{slugged(name)}"
    path, n = base, 2
    while True:
        try:
            path.mkdir(parents=True)
            break
        except FileExistsError:
            path, n = base.with_name(f"{base.name}-{n:02d}"), n + 1
    for part in RUN_FOLDERS:
        (path / part).mkdir()
    return path


def contract(values: dict) -> dict:
    """A checked record of how a phase is stored: vectors of three positive numbers, spacing, axes and encodings."""
    for key in ("target_box_A", "packing_box_A"):
        v = values.get(key)
        if v is not None and (len(v) != 3 or any(not np.isfinite(x) or x <= 0 for x in v)):
            raise ValueError(f"{key}: three positive numbers are needed")
    if not values.get("voxel_spacing_A", 0) > 0:
        raise ValueError("voxel_spacing_A: a positive number is needed")
    return {"axis_order": "z,y,x", "periodic_axes": ["x", "y"], "phase_encoding": {"semiconductor": 0, "pore": 1}} | values


def markdown_report(title: str, passed: bool, sections: dict[str, dict | list]) -> str:
    lines = [f"# {title}", "", f"Status: {'PASS' if passed else 'FAIL'}", ""]
    for name, body in sections.items():
        lines += [f"## {name}", ""]
        rows = [f"- {k}: {v}" for k, v in sorted(body.items())] if isinstance(body, dict) else [f"- {x}" for x in body]
        lines += [*(rows or ["- none"]), ""]
    return "\n".join(lines)


def exchange(requested: DataFrame, realised: DataFrame, gates: DataFrame, by: str = "run_id") -> DataFrame:
    """One row a run for an optimiser: requested and realised parameters apart, feasibility, gates, and the porosity error to be made small."""
    r = requested.select(by, F.struct(*[c for c in requested.columns if c != by]).alias("requested"))
    a = realised.select(by, F.struct(*[c for c in realised.columns if c != by]).alias("realized"))
    g = gates.groupBy(by).agg(F.bool_and("passed").alias("feasible"), F.sort_array(F.collect_list(F.struct("name", "passed"))).alias("constraints"))
    return r.join(a, by, "left").join(g, by, "left").withColumn("calculation_status", F.when(F.col("realized").isNull(), "failed").otherwise("completed"))
