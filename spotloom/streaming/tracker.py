"""Looking ahead over a stream of spots: the tracker of operators.forecast, with a state for each video.

A window of frames is planned once all frames it looks at are complete, which a spot of a later frame shows. State holds
the spots that are not placed yet, open tracks by their last points, and where windows stand, so it is bounded by the
frames that the tracker looks ahead, not by the length of a video. Points go out as soon as they are placed and are not
taken back; together they are those that `forecast.track` finds in the same spots.

State needs Spark's RocksDB provider: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from spotloom.functions.lookup import Quantiles
from spotloom.operators import forecast

OUT = "video string, start bigint, frame int, spot_idx int, x double, y double, z double"
_SPOT = ["frame", "spot_idx", "x", "y", "z"]


def _put(state: ListState, values: list[tuple]) -> None:
    """State takes no empty list."""
    state.put(values) if values else state.clear()


class Tracker(StatefulProcessor):
    """State by video: spots not placed, open tracks, and first frame, last window's end and newest frame."""

    def __init__(self, law: forecast.Law, lateness: int, patience_ms: int | None) -> None:
        self.law, self.lateness, self.patience_ms = law, lateness, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stand = handle.getValueState("stand", "first int, last int, newest int")
        self.spots = handle.getListState("spots", "frame int, spot_idx int, x double, y double, z double")
        self.ends = handle.getListState("ends", "start bigint, key array<bigint>, tail array<double>")

    def _plan(self, video: str, first: int, last: int, final: float, upto: float, spots: pd.DataFrame, newest: int) -> pd.DataFrame:
        """Plans windows that end by `upto`; what is placed goes out, and the rest is kept where more may come."""
        held, starts = {}, {}
        for start, key, tail in self.ends.get():
            held[tuple(key)], starts[tuple(key)] = np.reshape(tail, (-1, 5)).tolist(), start
        v = forecast._Video(spots, self.law, first, final, last, held)
        v.run(upto)
        out, ends = [], []
        for key, nodes in v.tracks.items():
            start = starts.get(key, forecast._code(nodes[0]))
            out += [(video, start, *n, *v.point(n).tolist()) for n in nodes[len(held.get(key, ())) :]]
            if key in v.open:
                recent = nodes[-forecast.RECENT :]
                ends.append((start, [int(k) for k in key], [float(c) for n in recent for c in (*n, *v.point(n))]))
        if final == np.inf:
            while v.last <= upto:  # no spots were left to plan, yet these windows are over
                v.last += self.law.horizon
            self.stand.update((first, v.last, newest))
            _put(self.spots, [(int(n[0]), int(n[1]), *v.point(n).tolist()) for n in sorted(v.free)])
            _put(self.ends, ends)
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def _finish(self, video: str) -> pd.DataFrame:
        first, last, newest = self.stand.get()
        out = self._plan(video, first, last, newest, np.inf, pd.DataFrame(list(self.spots.get()), columns=_SPOT), newest)
        for state in (self.stand, self.spots, self.ends):
            state.clear()
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        video, horizon = key[0], self.law.horizon
        come = pd.concat([r[_SPOT] for r in rows])
        over = come.frame.isna().any()
        come = come[come.frame.notna()].astype({"frame": int, "spot_idx": int})
        first, last, newest = self.stand.get() if self.stand.exists() else (None, None, None)
        if last is not None:  # windows have begun, so frames that were complete then are closed
            come = come[come.frame > newest - 1 - self.lateness]
        spots = pd.concat([pd.DataFrame(list(self.spots.get()), columns=_SPOT), come]) if self.spots.exists() else come
        if len(spots) or newest is not None:
            newest = max(int(come.frame.max()) if len(come) else newest, newest if newest is not None else -(1 << 31))
            complete = newest - 1 - self.lateness
            begin = int(spots.frame.min()) if first is None or last is None else first
            n = (complete - begin - horizon - 1) // horizon  # windows that end at begin + horizon * k, for k up to n, see complete frames only
            if last is None and n < 1:
                self.stand.update((begin, None, newest))
                _put(self.spots, [(int(f), int(i), float(x), float(y), float(z)) for f, i, x, y, z in spots[_SPOT].itertuples(index=False)])
            else:
                yield self._plan(video, begin, begin + horizon if last is None else last, np.inf, begin + horizon * n, spots, newest)
            if over:
                first, last, _ = self.stand.get()
                if last is None:
                    self.stand.update((first, first + horizon, newest))
                yield self._finish(video)
        if self.patience_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.stand.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.stand.exists():
            first, last, newest = self.stand.get()
            if last is None:
                self.stand.update((first, first + self.law.horizon, newest))
            yield self._finish(key[0])


def track_stream(
    loc: DataFrame, threshold: float, horizon: int = 3, alpha: forecast.Predictor = forecast.brownian, alternatives: int | None = None, jumps: np.ndarray | None = None,
    quantiles: Quantiles | None = None, k: forecast.Predictor = forecast.usual_k, lateness: int = 0, patience_ms: int | None = None,
) -> DataFrame:
    """Points with the first spot of their track (start), for a stream of spots (video, frame, spot_idx, x, y, z).

    A frame is complete once a spot comes that is more than `lateness` frames after it; spots of complete frames that come
    later still are left out. Frames may be split over micro-batches, and within the lateness come in any order. A row
    without frame says that its video is over; with patience_ms, so does a video without news for so long. What is not
    placed then is planned to the end and the video's state goes. `forecast.finish` makes trajectories of the points.
    """
    law = forecast.law(threshold, horizon, alternatives, alpha, jumps, quantiles, k)
    mode = "None" if patience_ms is None else "ProcessingTime"
    spots = loc.select("video", *_SPOT)
    return spots.groupBy("video").transformWithStateInPandas(Tracker(law, lateness, patience_ms), OUT, "append", mode)
