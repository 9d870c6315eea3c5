"""Extension: slices followed as they arrive. A stream of slice centres per run becomes track points, with the alive tracks as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxlake.functions import kernels as K

POINT = "run_id int, track_id int, z_index int, x double, y double, wall double"
STATE = "fresh int, ids array<int>, xs array<double>, ys array<double>"


def tracked(centers: DataFrame, box: tuple[float, float], reach: float) -> DataFrame:
    """Track points of a stream run_id, z_index, centers(x, y, wall); slices of a run come in order, those of a batch are sorted.

    Only the last slice's alive tracks are kept, however long a run.
    """
    side = np.array(box)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh, ids, xs, ys = state.get if state.exists else (0, [], [], [])
        rows = []
        for _, slice_ in pd.concat(list(frames)).sort_values("z_index").iterrows():
            centres = [(c["x"], c["y"], c["wall"]) for c in slice_["centers"]]
            taken = {}
            if len(ids) and centres:
                delta = np.array(list(zip(xs, ys, strict=True)))[:, None] - np.array([c[:2] for c in centres])[None]
                away = np.hypot(*np.moveaxis(delta - side * np.rint(delta / side), -1, 0))
                taken = {c: ids[r] for r, c in K.assignment(away) if away[r, c] <= reach}
            new = []
            for c, (x, y, wall) in enumerate(centres):
                track = taken.get(c)
                if track is None:
                    track, fresh = fresh, fresh + 1
                new.append(int(track))
                rows.append((key[0], int(track), int(slice_["z_index"]), x, y, wall))
            ids, xs, ys = new, [c[0] for c in centres], [c[1] for c in centres]
        state.update((fresh, [int(i) for i in ids], [float(x) for x in xs], [float(y) for y in ys]))
        yield pd.DataFrame(rows, columns=["run_id", "track_id", "z_index", "x", "y", "wall"])

    return centers.groupBy("run_id").applyInPandasWithState(run, POINT, STATE, "append", GroupStateTimeout.NoTimeout)


def progress(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Results per window and status, late ones within the watermark: what a running panel reports."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
