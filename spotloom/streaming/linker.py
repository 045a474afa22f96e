"""Linking spots as they arrive: state by video, with frames as event time and the horizon as patience."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "video string, traj_idx bigint, frame int, x double, y double, z double"
_STATE = "next bigint, last_frame int, ids array<bigint>, frames array<int>, xs array<double>, ys array<double>, zs array<double>, wframes array<int>, wxs array<double>, wys array<double>, wzs array<double>"


def advance(open_: list[tuple], spots: np.ndarray, frame: int, threshold: float, horizon: int, next_id: int) -> tuple[list[tuple], list[int], int]:
    """Links the spots of a frame to open ends (id, frame, x, y, z), nearest first; others open trajectories."""
    live = [o for o in open_ if frame - o[1] - 1 <= horizon]
    names = [-1] * len(spots)
    if live and len(spots):
        ends = np.array([o[2:] for o in live])
        d = np.sqrt(((ends[:, None, :] - spots[None, :, :]) ** 2).sum(2))
        pairs = np.argwhere(d < threshold)
        for i, j in pairs[np.argsort(d[pairs[:, 0], pairs[:, 1]], kind="stable")]:
            if live[i] is not None and names[j] < 0:
                names[j] = live[i][0]
                live[i] = None
    for j in range(len(spots)):
        if names[j] < 0:
            names[j], next_id = next_id, next_id + 1
    return [o for o in live if o is not None] + [(names[j], frame, *spots[j].tolist()) for j in range(len(spots))], names, next_id


def link_stream(loc: DataFrame, threshold: float, horizon: int = 3, patience_ms: int | None = None) -> DataFrame:
    """Points with their trajectory's number, for a stream of spots (video, frame, x, y, z).

    A frame is linked once a spot of a later frame of its video comes, so a frame may be split over micro-batches and
    frames may come out of order within one; the newest frame waits. With patience_ms, a video without news for so long
    has its waiting frame linked too, and its state goes. Spots of frames that were already linked are late and dropped.
    State holds the open ends of a video, those that ended within the horizon, and the spots that wait.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_id, last, open_, waiting = 0, -(1 << 31), [], []
        if state.exists:
            next_id, last, ids, frames, xs, ys, zs, *held = state.get
            open_, waiting = list(zip(ids, frames, xs, ys, zs, strict=True)), list(zip(*held, strict=True))
        over = state.hasTimedOut
        spots = pd.concat([pd.DataFrame(waiting, columns=["frame", "x", "y", "z"]), *([] if over else [b[["frame", "x", "y", "z"]] for b in batches])])
        spots = spots[spots.frame > last].sort_values(["frame", "x", "y"], kind="stable")
        newest = None if over or not len(spots) else spots.frame.max()
        out = []
        for frame, g in spots[spots.frame != newest].groupby("frame"):
            open_, names, next_id = advance(open_, g[["x", "y", "z"]].to_numpy(float), int(frame), threshold, horizon, next_id)
            out.append(pd.DataFrame({"video": key[0], "traj_idx": names, "frame": int(frame), "x": g.x.to_numpy(), "y": g.y.to_numpy(), "z": g.z.to_numpy()}))
            last = int(frame)
        waiting = spots[spots.frame == newest][["frame", "x", "y", "z"]]
        if over:
            state.remove()
        else:
            cells = [list(c) for c in zip(*open_, strict=True)] if open_ else [[] for _ in range(5)]
            state.update((next_id, last, *cells, [int(f) for f in waiting.frame], *(waiting[c].astype(float).tolist() for c in "xyz")))
            if patience_ms is not None:
                state.setTimeoutDuration(patience_ms)
        if out:
            yield pd.concat(out)

    timeout = GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return loc.groupBy("video").applyInPandasWithState(step, OUT, _STATE, "append", timeout)
