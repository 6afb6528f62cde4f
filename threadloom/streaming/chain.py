"""An author's signed events in whatever order they come: numbers, parents, gaps, replays and broken chains, by keyed state.

Each event names its author, number and parents. State holds the event under each number that was accepted, and a gap
with its parents for each event whose predecessor hasn't come. An event is refused as a ``replay`` if another one has its
number, and as ``broken`` if it is the first and has parents, if it doesn't name its predecessor, or if its successor
came earlier and doesn't name it. Whatever is refused leaves no trace in the state, so a right event can still come.

An author's history is in the state store in blocks of ``BLOCK`` numbers. A call reads the blocks that its events touch,
each once and none for a new author, and writes those that changed once, so a history may be long and an event asks the
store for nothing of its own. The same processor runs in batches and streams; state of maps by number, as it was kept
before, isn't read. Events of one author in a batch are taken in order of ``arrived``, then by number and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from threadloom.runtime import keep_state_in_rocksdb, share_code

KEY = ["workspace", "author"]
#: Numbers of an author that are one value of the state.
BLOCK = 256
OUT = "workspace string, author string, seq long, event string, status string, gap boolean, fills long"


class Chain(StatefulProcessor):
    """One row an event: ``status``, accepted, repeated, replay or broken; ``gap``, whether its predecessor is missing; ``fills``, the number whose gap it closes."""

    def init(self, handle) -> None:
        self.blocks = handle.getMapState("blocks", "block long", "seqs array<long>, events array<string>, gaps array<long>, parents array<array<string>>")

    def _block(self, seq: int) -> tuple[dict[int, str], dict[int, list[str]]]:
        """Accepted events and gaps of the block that holds ``seq``; read at most once a call."""
        n = seq // BLOCK
        if n not in self.read:
            self.read[n] = ({}, {})
            if self.old and self.blocks.containsKey((n,)):
                seqs, events, gaps, parents = self.blocks.getValue((n,))
                self.read[n] = (dict(zip(seqs, events, strict=True)), {k: list(p) for k, p in zip(gaps, parents, strict=True)})
        return self.read[n]

    def _event(self, seq: int) -> str | None:
        return self._block(seq)[0].get(seq)

    def _take(self, seq: int, event: str, parents: list[str]) -> tuple[str, bool, int | None]:
        known = self._event(seq)
        if known is not None:
            return ("repeated" if known == event else "replay", False, None)
        before, after = self._event(seq - 1), self._event(seq + 1)
        if (seq == 1 and parents) or (before is not None and before not in parents):
            return ("broken", False, None)
        if after is not None and event not in self._block(seq + 1)[1].get(seq + 1, []):
            return ("broken", False, None)
        self._block(seq)[0][seq] = event
        self.changed.add(seq // BLOCK)
        gap = seq > 1 and before is None
        if gap:
            self._block(seq)[1][seq] = parents
        if after is not None:
            self._block(seq + 1)[1].pop(seq + 1, None)
            self.changed.add((seq + 1) // BLOCK)
        return ("accepted", gap, seq + 1 if after is not None else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # what is read and changed is this call's only
        self.old, self.read, self.changed = self.blocks.exists(), {}, set()
        came = [(a, int(s), e, p) for x in rows for a, s, e, p in zip(x["arrived"], x["seq"], x["event"], x["parents"], strict=True)]
        # without a time of arrival: last
        came.sort(key=lambda r: (True, 0, r[1], r[2] or "") if pd.isna(r[0]) else (False, *r[:2], r[2] or ""))
        took = [self._take(s, e, [] if p is None else list(p)) for _, s, e, p in came]
        for n in sorted(self.changed):
            events, gaps = self.read[n]
            self.blocks.updateValue((n,), (list(events), list(events.values()), list(gaps), list(gaps.values())))
        yield pd.DataFrame({
            "workspace": [key[0]] * len(came), "author": [key[1]] * len(came), "seq": [s for _, s, _, _ in came], "event": [e for _, _, e, _ in came],
            "status": [t for t, _, _ in took], "gap": [g for _, g, _ in took], "fills": pd.array([f for _, _, f in took], dtype="Int64"),
        })

    def close(self) -> None:
        """Nothing is held outside the state."""


def verified(events: DataFrame) -> DataFrame:
    """Each of ``events`` (workspace, author, seq, event, parents, arrived) with what the chain says of it; a batch or a stream."""
    share_code(events.sparkSession)
    keep_state_in_rocksdb(events.sparkSession)
    named = events.select(*KEY, F.col("seq").cast("long").alias("seq"), "event", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"), "arrived")
    return named.groupBy(*KEY).transformWithStateInPandas(Chain(), OUT, "append", "None")


def open_gaps(log: DataFrame) -> DataFrame:
    """Of a log of ``verified``: the numbers whose predecessor is still missing."""
    closed = log.filter("status = 'accepted' and fills is not null").select(*KEY, F.col("fills").alias("seq"))
    return log.filter("status = 'accepted' and gap").select(*KEY, "seq", "event").join(closed, [*KEY, "seq"], "left_anti")


def history_faults(log: DataFrame, boundaries: DataFrame, start: int, deferred: DataFrame | None = None) -> DataFrame:
    """Why a history isn't whole: ``fault`` and what it is about. ``boundaries``: workspace, epoch, author, seq, event.

    A gap; a required event that can't be read (``deferred``: workspace, author, seq, required); a boundary of an epoch
    from ``start`` on whose head isn't the accepted event of that number.
    """
    faults = open_gaps(log).select(*KEY, "seq", F.lit("gap").alias("fault"))
    if deferred is not None:
        faults = faults.unionByName(deferred.filter("required").select(*KEY, F.col("seq").cast("long").alias("seq"), F.lit("unsupported").alias("fault")))
    heads = boundaries.filter(F.col("epoch") >= start).select(*KEY, F.col("seq").cast("long").alias("seq"), "event")
    lost = heads.join(log.filter("status = 'accepted'").select(*KEY, "seq", "event"), [*KEY, "seq", "event"], "left_anti")
    return faults.unionByName(lost.select(*KEY, "seq", F.lit("boundary").alias("fault")).distinct())
