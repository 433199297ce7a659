"""Steps of many sessions at once: the k-th rows of all sessions of a partition are one numpy step.

Spark deals sessions to partitions and numbers each one's rows; the sessions of a partition are cut into
blocks of so many rows, and a block is sorted by that number instead of by session, so a task sees wave after
wave of one block after the other. What a task holds is the state of a block's sessions and one wave of rows,
however long they are and however many sessions a partition has; a session's state goes with its last row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Stack(Protocol):
    """The states of a partition's sessions, in a fixed order."""

    def step(self, rows: pa.Table) -> tuple[np.ndarray, dict]:
        """One row of each session, in order: which rows the output is for, and its columns."""

    def keep(self, on: np.ndarray) -> None:
        """Go on with these sessions alone."""


def together(rows: DataFrame, session: str, order: list[Column], columns: list[str], make: Callable[[int], Stack], schema: str, *, hold: int = 8192, block: int = 65_536, wide: int = 1024) -> DataFrame:
    """The ``columns`` of each session's rows, in ``order``, through a stack that ``make`` builds for a number of sessions.

    ``schema`` has the output's columns after the session. One shuffle by session; a null session is a session. A block's sessions begin
    within ``block`` rows of a partition; a stack has at most ``wide`` of them.
    """
    w = Window.partitionBy(session)
    # rows stand by session after the first window, so the least number of a session's rows is its beginning's
    numbered = rows.select(session, F.row_number().over(w.orderBy(*order)).alias("k"), *columns).withColumn("at", F.monotonically_increasing_id())
    blocks = numbered.select(F.col(session).alias("session"), "k", F.count("*").over(w).alias("n"), F.floor(F.min("at").over(w) / block).alias("block"), *columns)
    waves = blocks.sortWithinPartitions("block", "k", "session")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks: list[tuple[Stack, int]] = []
        parts, now = [], (-1, 0)
        out: list[pa.Table] = []
        size = 0

        def step() -> None:
            """The next row of all sessions of a block that have one."""
            nonlocal stacks, size
            wave = pa.Table.from_batches(parts).combine_chunks()
            rest, i = [], 0
            for stack, live in stacks or [(None, min(wide, wave.num_rows - i)) for i in range(0, wave.num_rows, wide)]:
                some = wave.slice(i, live)
                i += live
                stack = stack or make(live)
                at, got = stack.step(some.select(columns))
                if len(at):
                    out.append(pa.table([some["session"].take(pa.array(at, pa.int64())), *(pa.array(x, from_pandas=True) for x in got.values())], [session, *got]))
                    size += len(at)
                on = some["n"].to_numpy() > now[1]
                if not on.all():
                    stack.keep(on)
                if on.any():
                    rest.append((stack, int(on.sum())))
            stacks = rest

        for b in batches:
            k, own = b.column(1).to_numpy(), b.column(3).to_numpy()
            cuts = np.r_[0, np.flatnonzero((np.diff(k) != 0) | (np.diff(own) != 0)) + 1, len(k)] if len(k) else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if parts and (own[i], k[i]) != now:
                    step()
                    parts = []
                now = (int(own[i]), int(k[i]))
                parts.append(b.slice(i, j - i))
            if size >= hold:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, size = [], 0
        if parts:
            step()
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return waves.mapInArrow(run, f"{session} {dict(rows.dtypes)[session]}, {schema}")


def padded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of arrays as a matrix; what an array has not is NaN."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    size = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    out = np.full((len(lists), width), np.nan)
    row = np.repeat(np.arange(len(lists)), size)
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    fits = at < width
    out[row[fits], at[fits]] = values[fits]
    return out
