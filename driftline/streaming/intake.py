"""Intake by two clocks: what a live session accepts of its records, and why it refuses the rest.

A record has the time it was measured (t_us), the time it was received (received_us) and the time it is
offered (admitted_us, else the time of the trigger). Each record gets one code, in this order:

INVALID    no id, time or value, or a time before the session's origin
LATE       measured before the session's calibration
DUPLICATE  not newer than the channel's newest record, or an id that the session has had
LATE       received after it is offered, or longer ago than the largest lag
DROPPED    beyond what a session takes in one trigger
ACCEPTED

A record that is refused for its lag or dropped still counts as the channel's newest, and its id as had.

What is kept for a session is one time for each channel, and the ids that were received within ``remember_us`` of its
newest record; a session that is not heard of for ``idle`` milliseconds ends, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIELDS = ["channel", "event_id", "t_us", "received_us", "admitted_us", "value", "origin_us", "calibrated_us"]
STATE = "channels array<string>, floors array<long>, ids array<long>, id_us array<long>"
SCHEMA = "session long, channel string, event_id long, t_us long, code string"


def _coded(pdf: pd.DataFrame, floors: dict[str, int], ids: dict[int, int], most_lag_us: int, capacity: int | None) -> list[str]:
    """The codes of a session's records in order; ``floors`` and ``ids`` go on with them."""
    codes, taken = [], 0
    for channel, event_id, t, received, offered, value, origin, calibrated in pdf[FIELDS].itertuples(index=False, name=None):
        if any(pd.isna(x) for x in (channel, event_id, t, value)) or t < 0 or (not pd.isna(origin) and t < origin):
            codes.append("INVALID")
        elif not pd.isna(calibrated) and t < calibrated:
            codes.append("LATE")
        elif t <= floors.get(channel, -1) or event_id in ids:
            codes.append("DUPLICATE")
        else:
            floors[channel], ids[int(event_id)] = int(t), int(offered)
            if not pd.isna(received) and (received > offered or offered - received > most_lag_us):
                codes.append("LATE")
            elif capacity is not None and taken >= capacity:
                codes.append("DROPPED")
            else:
                codes.append("ACCEPTED")
                taken += 1
    return codes


def admitted(stream: DataFrame, *, most_lag_us: int, capacity: int | None = None, idle_ms: int = 0, remember_us: int | None = None) -> DataFrame:
    """session, channel, event_id, t_us and code of every record of ``stream`` (session and :data:`FIELDS`; ids and times are longs).

    A trigger's rows of a session are taken in order of ``admitted_us``. ``idle_ms`` ends a session with a row ``ENDED`` (0: never),
    ``remember_us`` forgets ids (None: never, so that the state grows with the session).
    """
    whole = ["event_id", "t_us", "received_us", "admitted_us", "origin_us", "calibrated_us"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "channel": [None], "event_id": pd.array([None], "Int64"), "t_us": pd.array([None], "Int64"), "code": ["ENDED"]})
            return
        pdf = pd.concat(list(frames))
        pdf[whole] = pdf[whole].astype("Int64")
        now = state.getCurrentProcessingTimeMs() * 1000
        pdf["admitted_us"] = pdf["admitted_us"].fillna(now)
        pdf = pdf.sort_values(["admitted_us", "event_id", "t_us"], kind="stable", na_position="last")
        floors, ids = {}, {}
        if state.exists:
            channels, times, seen, at = state.get
            floors, ids = dict(zip(channels, times, strict=True)), dict(zip(seen, at, strict=True))
        codes = _coded(pdf, floors, ids, most_lag_us, capacity)
        if remember_us is not None:
            newest = int(pdf["admitted_us"].max())
            ids = {k: v for k, v in ids.items() if v >= newest - remember_us}
        state.update((list(floors), list(floors.values()), list(ids), list(ids.values())))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session": np.full(len(pdf), key[0]), "channel": pdf["channel"].to_numpy(), "event_id": pdf["event_id"].to_numpy(dtype=object), "t_us": pdf["t_us"].to_numpy(dtype=object), "code": codes}).astype({"event_id": "Int64", "t_us": "Int64"})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    given = stream.select("session", *FIELDS)
    return given.groupBy("session").applyInPandasWithState(run, SCHEMA, STATE, "append", timeout)


def two_clocks(stream: DataFrame, *, repeats: int = 10) -> DataFrame:
    """Records as a gateway offers them: measured, received and offered times from the row's number; each ``repeats``-th one comes again on another channel."""
    lag = (F.col("event_id") * 37) % 50 * 60_000_000
    wait = (F.col("event_id") * 13) % 90 * 60_000_000 - 60_000_000
    copies = F.explode(F.when(F.col("event_id") % repeats == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = stream.select("session", "channel", "event_id", "t_us", "value", (F.col("t_us") + lag).alias("received_us"), wait.alias("wait"), copies.alias("copy"))
    again = F.col("copy") == 1
    return rows.select(
        "session", F.when(again, "relay").otherwise(F.col("channel")).alias("channel"), "event_id", "t_us", "received_us", (F.col("received_us") + F.when(again, 7_200_000_000).otherwise(F.col("wait"))).alias("admitted_us"),
        F.when(F.col("event_id") % 23 > 0, F.col("value")).alias("value"), F.lit(1_704_067_200_000_000 + 6 * 3_600_000_000).alias("origin_us"), F.lit(1_704_067_200_000_000 + 24 * 3_600_000_000).alias("calibrated_us"),
    )
