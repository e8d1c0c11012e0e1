"""Tracks of steady tones over lines that keep coming: the fold of operators.hum.tracks as keyed state with event-time timers.

Lines wait until the watermark has passed them, so they are taken in order however they arrive; a track is told once, when nothing can go on it or join it any more. Needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reedline.operators import hum

_COLUMNS = [c for c in hum._TRACK.split(", ") if c != "track int"]
SCHEMA = ", ".join(_COLUMNS)
#: Windows after a track's last one in which a piece may still join it.
_REACH = round(hum.TRACK["join_s"] / hum.LINE["hop_s"])
#: Silence (ms) after which no open track can go on and no piece can join one.
_OVER_MS = int(1000 * hum.LINE["hop_s"] * (hum.TRACK["missed"] + 1 + _REACH + 1))


def tracks(lines: DataFrame, late: str) -> DataFrame:
    """Steady tones of a stream of lines: file, hz, first, last and the measures of hum.tracks, each once.

    lines: file, window, hz, level_db, prominence_db and at, the time (timestamp) of the window, which goes on by LINE["hop_s"] a window. Lines later than the watermark (`late` behind the latest) are
    left out. Leakage of louder tones is not taken out, as that looks at finished tracks: see hum.tracks. State: the lines of `late`, the open tracks, and those of the last few seconds.
    """
    timed = lines.withWatermark("at", late).select("file", "window", "hz", "level_db", "prominence_db", "at")
    return timed.groupBy("file").transformWithStateInPandas(TrackProcessor(), SCHEMA, "append", "EventTime")


class TrackProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "window long, hz double, level_db double, prominence_db double, at_ms long")
        self.tracker = handle.getValueState("tracker", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            at = part["at"].astype("datetime64[ms]").astype("int64")
            self.waiting.appendList([(int(w), float(hz), float(db), float(p), int(t)) for w, hz, db, p, t in zip(part["window"], part["hz"], part["level_db"], part["prominence_db"], at)])
            self.handle.registerTimer(int(at.max()) + 1)
        yield pd.DataFrame(columns=[c.split()[0] for c in _COLUMNS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for line in self.waiting.get() if self.waiting.exists() else ():
            (due if line[4] <= now else rest).append(line)
        state = pickle.loads(self.tracker.get()[0]) if self.tracker.exists() else {"live": [], "pieces": [], "joined": [], "window": -1, "at_ms": -1}
        windows: dict[int, list] = {}
        for window, hz, level, prominence, at in due:
            windows.setdefault(window, []).append((hz, level, prominence))
            state["at_ms"] = max(state["at_ms"], at)
        for window in sorted(windows):
            state["pieces"] += filter(hum.lasts, hum.step(state["live"], window, windows[window]))
            state["window"] = window
        over = now > state["at_ms"] + _OVER_MS
        found = self._final(state, over)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if state["live"] or state["pieces"] or state["joined"]:
            self.tracker.update((pickle.dumps(state),))
            self.handle.registerTimer(state["at_ms"] + _OVER_MS + 1)
        else:
            self.tracker.clear()
        yield pd.DataFrame([(r := hum.measured(key[0], 0, t))[:1] + r[2:] for t in found], columns=[c.split()[0] for c in _COLUMNS])

    @staticmethod
    def _final(state: dict, over: bool) -> list[list]:
        """Tracks that nothing can change any more, taken out of the state."""
        if over:
            state["pieces"] += filter(hum.lasts, state["live"])
            state["live"] = []
        # a piece joins only after all that began before it, so those wait for open tracks that are older
        oldest = min((t[0][:2] for t in state["live"]), default=None)
        state["pieces"].sort(key=lambda t: t[0][:2])
        while state["pieces"] and (oldest is None or state["pieces"][0][0][:2] < oldest):
            hum.join_piece(state["joined"], state["pieces"].pop(0))
        begins = min((t[0][0] for t in [*state["live"], *state["pieces"]]), default=state["window"] + 1)
        done = [t for t in state["joined"] if over or begins > t[-1][0] + _REACH and state["window"] > t[-1][0] + _REACH]
        state["joined"] = [t for t in state["joined"] if not any(t is d for d in done)]
        return list(filter(hum.steady, done))
