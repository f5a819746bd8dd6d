"""The segmenter over a stream: samples arrive in micro-batches, finished segments leave.

State of a track is eight numbers: the next segment, and what is pending of it. A segment leaves as soon as the keyframe that
ends it is there, with the audio that arrived before that; audio that arrives before the first video sample is kept for the first
segment. A row with is_end flushes the rest; with no video pending that does nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.fold import by_keyframe

OUTPUT = "track long, seg_idx long, first_sample long, n long, ticks long, bytes long, n_audio long, audio_ticks long, audio_bytes long"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
STATE = "seg_idx long, first_sample long, n long, ticks long, bytes long, n_audio long, audio_ticks long, audio_bytes long"


class Segmenter(StatefulProcessor):
    def __init__(self, target: int) -> None:
        self.step = by_keyframe(max(target, 1), "duration", "is_sync")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def add(self, state: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        """The state after some samples, and the segments that they finish (as states)."""
        audio = rows["is_audio"].to_numpy(bool)
        video = rows[~audio]
        made = np.zeros(0, np.int64)
        if len(video):
            _, made = self.step((0, int(state[3])) if state[2] else None, {c: video[c].to_numpy() for c in ("duration", "is_sync")})
        at = np.zeros(len(rows), np.int64)
        at[~audio] = made
        at = np.maximum.accumulate(at)  # audio is of the segment that is open when it arrives
        count = int(at[-1]) + 1
        whole = np.zeros((count, 8), np.int64)
        whole[:, 0] = state[0] + np.arange(count)
        for first, mine in ((2, ~audio), (5, audio)):
            for c, column in enumerate((None, "duration", "size")):
                np.add.at(whole[:, first + c], at[mine], 1 if column is None else rows[column].to_numpy(np.int64)[mine])
        segments, places = np.unique(made, return_index=True)
        whole[segments, 1] = video["sample_idx"].to_numpy(np.int64)[places]
        whole[0, 1] = state[1] if state[2] else whole[0, 1]
        whole[0, 2:] += state[2:]
        return whole[-1], list(whole[:-1])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        frame = pd.concat(list(rows)).sort_values("pos", kind="stable").reset_index(drop=True)
        state = np.array(self.state.get() if self.state.exists() else (0,) * 8, np.int64)
        out: list[np.ndarray] = []
        ends = np.flatnonzero(frame["is_end"].to_numpy(bool)).tolist()
        for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(frame)], strict=True):
            if b > a:
                state, done = self.add(state, frame.iloc[a:b])
                out += done
            if b < len(frame) and state[2]:
                out.append(state)
                state = np.array([state[0] + 1, *(0,) * 7], np.int64)
        self.state.update(tuple(int(x) for x in state))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=NAMES).astype("int64")

    def close(self) -> None:
        pass


def stream_segments(samples: DataFrame, target: int) -> DataFrame:
    """Segments of a streaming DataFrame of track, pos, sample_idx, duration, is_sync, size, is_audio and is_end.

    Within a track, batches must come in order; pos is the order in a batch (timeline.merge gives it).
    """
    return samples.groupBy("track").transformWithStateInPandas(Segmenter(target), OUTPUT, "Append", "none")
