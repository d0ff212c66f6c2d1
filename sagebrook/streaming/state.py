"""Streaming twins of keyed state: upserts with expiry, confidence folds, arrival dedup."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import CONFIG, Config
from ..operators import folds
from ..sources.keyed import KeyedTable

_FAR = 2**62


def upsert_stream(writes: DataFrame, path: str, checkpoint: str, as_of: Column | None = None):
    """Keeps the ``KeyedTable`` at ``path`` current with a stream of writes, a delta a batch.

    A batch that is run again changes nothing, and a late write with an older seq changes nothing
    but, if it is the first, the time of creation.  With ``as_of`` what expired before it goes with
    every batch.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table = KeyedTable(batch.sparkSession, path)
        table.write(batch, number)
        if as_of is not None:
            table.compact(as_of)

    return writes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _change(delta: int, below: int) -> tuple[int, int, int, int]:
    """``folds.change`` of one number: (lo, hi, shift, drop)."""
    return (-_FAR, folds.UNIT, delta, -_FAR) if delta >= 0 else (0, _FAR, delta, below - delta)


def _then(f: tuple[int, ...], g: tuple[int, ...]) -> tuple[int, int, int, int]:
    """``folds.then`` of numbers."""
    lo, hi = (min(g[1], max(g[0], x + g[2])) for x in f[:2])
    under = _FAR if f[1] < g[3] else g[3] - f[2] if f[0] < g[3] else -_FAR
    return lo, hi, f[2] + g[2], max(f[3], under)


class _Folder(StatefulProcessor):
    """An entity's changes in blocks of their order, each with the function it composes to.

    A late change is put in its place: its block alone is composed again, and then the blocks.
    """

    def __init__(self, width: int, below: int) -> None:
        self.width, self.below = width, below

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start = handle.getValueState("start", "confidence double, lifecycle_state string")
        self.changes = handle.getMapState("changes", "block long", "seqs array<long>, deltas array<long>")
        self.functions = handle.getMapState("functions", "block long", "lo long, hi long, shift long, drop long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, list[tuple[int, int]]] = {}
        for frame in rows:
            if not self.start.exists():
                first = frame.iloc[0]
                self.start.update((None if pd.isna(first["confidence"]) else float(first["confidence"]), first["lifecycle_state"]))
            for seq, delta in zip(frame["seq"], frame["delta"]):
                if not pd.isna(delta):
                    arrived.setdefault(int(seq) // self.width, []).append((int(seq), round(float(delta) * folds.UNIT)))
        for block, new in arrived.items():
            have = self.changes.getValue((block,)) if self.changes.containsKey((block,)) else ([], [])
            steps = sorted([*zip(have[0], have[1]), *new])
            self.changes.updateValue((block,), ([s for s, _ in steps], [d for _, d in steps]))
            f = reduce(_then, (_change(d, self.below) for _, d in steps))
            self.functions.updateValue((block,), (*f, len(steps)))
        blocks = sorted((k[0], tuple(v)) for k, v in self.functions.iterator())
        confidence, state = self.start.get()
        if blocks and confidence is not None:
            lo, hi, shift, drop = reduce(_then, (f[:4] for _, f in blocks))
            before = round(confidence * folds.UNIT)
            confidence = min(hi, max(lo, before + shift)) / folds.UNIT
            state = "ARCHIVED" if before < drop and state == "TRUSTED" else state
        n = sum(f[4] for _, f in blocks)
        yield pd.DataFrame({"entity_id": [key[0]], "confidence": [confidence], "lifecycle_state": [state], "n_changes": [n]})

    def close(self) -> None:
        pass


def fold_stream(changes: DataFrame, config: Config = CONFIG, width: int = 1024) -> DataFrame:
    """(entity_id, confidence, lifecycle_state, n_changes) of every entity with new changes, after
    each batch of (entity_id, seq, delta, confidence, lifecycle_state); the last two start an entity
    that is new to the stream.

    Changes count in the order of seq, a long, whenever they come: after any batch the outcome is
    that of ``folds.fold`` over all that has come.  ``width`` numbers share a block of state.  The
    session needs the state store of RocksDB.
    """
    below = round(config.archive_below * folds.UNIT)
    return changes.groupBy("entity_id").transformWithStateInPandas(
        _Folder(width, below), "entity_id string, confidence double, lifecycle_state string, n_changes long", "Update", "None"
    )


def first_arrivals(rows: DataFrame, time: str, delay: str, *key: str) -> DataFrame:
    """The first row of each key within a delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def windowed_counts(rows: DataFrame, time: str, delay: str, width: str, *by: str) -> DataFrame:
    """Rows per window of time, late ones within a delay included (an extension)."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
