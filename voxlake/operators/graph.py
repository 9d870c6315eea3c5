"""Connected components, on link tables and on voxel lattices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.kernels import block_components
from voxlake.operators.voxels import lattice
from voxlake.tables import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of `links` the smallest node reachable.

    Each round takes the least label among a node's neighbours (a partial aggregate, so a hub costs each task one
    row) and then the label's own label; labels are written to the shared folder between rounds, never collected.
    Null ends are ignored; an empty table gives an empty result.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = written(edges.union(edges.select("b", "a")).distinct().select("a", "b"), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select("a", "label")
        mine = labels.select(F.col("node").alias("a"), "label")
        least = told.union(mine).groupBy("a").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        stepped = least.join(up, "label").select(F.col("a").alias("node"), F.least("label", "above").alias("label"))
        new = written(stepped, "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        dropped(labels)
        labels = new
        if not changed:
            dropped(both)
            return labels.select("node", F.col("label").alias("component"))


#: Voxels a side of the blocks that are labelled on their own.
BLOCK = 32


def _in_blocks(pore: DataFrame, block: int) -> DataFrame:
    """id, x, y, z and root of every pore voxel: the least id that is connected with it inside its block. A block is a task's group, of block**3 voxels at most."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["z", "y", "x"], ignore_index=True)
        x, y, z = (frame[c].to_numpy() % block for c in "xyz")
        mask = np.zeros((block, block, block), bool)
        mask[z, y, x] = True
        return frame[["id", "x", "y", "z"]].assign(root=frame["id"].to_numpy()[block_components(mask)])

    at = [F.floor(F.col(c) / block).alias(f"_b{c}") for c in "xyz"]
    return pore.where("pore").select("id", "x", "y", "z", *at).groupBy("_bx", "_by", "_bz").applyInPandas(run, "id bigint, x int, y int, z int, root bigint")


def _border_links(rooted: DataFrame, shape: tuple[int, int, int], periodic: tuple[bool, bool], block: int) -> DataFrame:
    """(a, b): roots of neighbouring pore voxels in different blocks, or across a wrapping border; only voxels on block faces meet."""
    nx, ny, nz = shape
    out = None
    for c, (n, wraps) in {"x": (nx, periodic[0]), "y": (ny, periodic[1]), "z": (nz, False)}.items():
        last = F.col(c) == n - 1
        leaves = (F.col(c) % block == block - 1) & ~last | (last if wraps else F.lit(False))
        at = {k: F.col(k) for k in "xyz"}
        at[c] = F.when(last, 0).otherwise(F.col(c) + 1)
        ahead = rooted.where(leaves).select((at["x"] + nx * (at["y"] + ny * at["z"].cast("bigint"))).alias("id"), F.col("root").alias("a"))
        part = ahead.join(rooted.where(F.col(c) % block == 0).select("id", F.col("root").alias("b")), "id").select("a", "b")
        out = part if out is None else out.union(part)
    return out.where("a <> b").distinct()


def labels(pore: DataFrame, shape: tuple[int, int, int], periodic: tuple[bool, bool] = (True, True), block: int = BLOCK) -> DataFrame:
    """id, x, y, z, label of every pore voxel: the least id of its 6-connected component; x and y wrap where periodic says so, z never.

    In two levels: blocks of the lattice are labelled on their own, then the roots that touch across block faces are
    components of a graph of their own. Rounds grow with the way through blocks, not through voxels, and a lattice of
    one block needs none but for its borders.
    """
    rooted = written(_in_blocks(pore, block), "blocks")
    found = components(_border_links(rooted, shape, periodic, block))
    return rooted.join(found.withColumnRenamed("node", "root"), "root", "left").select("id", "x", "y", "z", F.coalesce("component", "root").alias("label"))


def component_summary(labelled: DataFrame) -> DataFrame:
    """components and the largest one's share of the pore."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), (F.max("n") / F.sum("n")).alias("largest_fraction"))


def open_faces(labelled: DataFrame, nz: int) -> DataFrame:
    """label, and whether its component opens at the bottom and at the top."""
    return labelled.groupBy("label").agg(F.bool_or(F.col("z") == 0).alias("bottom"), F.bool_or(F.col("z") == nz - 1).alias("top"))


def through_networks(labelled: DataFrame, nz: int) -> DataFrame:
    """Components that are at the bottom and at the top: an intersection of two label sets."""
    low = labelled.where(F.col("z") == 0).select("label")
    high = labelled.where(F.col("z") == nz - 1).select("label")
    return low.intersect(high).agg(F.count("*").alias("through_networks"))


def percolates_x(pore: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Whether a way leads from the first to the last x, with y but not x wrapping."""
    found = labels(pore, shape, (False, True))
    reach = found.groupBy("label").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return reach.agg(F.coalesce(F.bool_or((F.col("low") == 0) & (F.col("high") == shape[0] - 1)), F.lit(False)).alias("percolates"))


def winds_x(pore: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Whether a component of the 3 x 3 tiling touches the middle tile and spans from before it to behind it along x."""
    nx, ny, nz = shape
    spark = pore.sparkSession
    tiles = spark.range(9).select((F.col("id") % 3).cast("int").alias("i"), F.floor(F.col("id") / 3).cast("int").alias("j"))
    wide = pore.crossJoin(F.broadcast(tiles)).select(  # nine rows
        (F.col("x") + nx * F.col("i") + 3 * nx * ((F.col("y") + ny * F.col("j")) + 3 * ny * F.col("z"))).cast("bigint").alias("id"), (F.col("x") + nx * F.col("i")).alias("x"), (F.col("y") + ny * F.col("j")).alias("y"), "z", "pore"
    )
    found = labels(wide, (3 * nx, 3 * ny, nz), (False, False))
    middle = F.bool_or(F.col("x").between(nx, 2 * nx - 1) & F.col("y").between(ny, 2 * ny - 1))
    spans = found.groupBy("label").agg(F.min("x").alias("low"), F.max("x").alias("high"), middle.alias("middle"))
    return spans.agg(F.coalesce(F.bool_or(F.col("middle") & (F.col("low") < nx) & (F.col("high") >= 2 * nx)), F.lit(False)).alias("winds"))


__all__ = ["component_summary", "components", "labels", "lattice", "open_faces", "percolates_x", "through_networks", "winds_x"]
