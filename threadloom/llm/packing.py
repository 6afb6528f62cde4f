"""Best-fit packing by a linear grouping scheme.

A plan is made on the driver from the histogram of lengths alone, which has at most ``capacity`` rows whatever the
input; its runs stand for any number of sequences. Large lengths are sorted and cut into groups of equal
cardinality, each rounded up to its longest. Configurations of these few sizes are optimised by column generation
(a linear programme with a knapsack for pricing), rounded down, and what is left is placed first-fit decreasing.
The actual documents of a group then take its places, longest first, and small lengths go best-fit into the room
that is left, longest first. Few or narrow lengths can round up badly, so a second plan places all lengths best-fit,
longest first, from the same histogram, and the one of fewer sequences is taken. Documents are numbered within their length, and a look-up of (length, number) in the
plan gives sequence and offset.

Defined results: a null text packs as an empty one. Every document has its end token, so each has a piece. Only
documents of more than ``capacity`` tokens are cut. Repeated rows are packed once each. An empty table gives an
empty result. Extra columns are ignored. One very long text is tokenised by one task, as one row.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.bpe import encoder, tokenizer_path
from threadloom.llm.ranks import numbered
from threadloom.llm.workers import parts
from threadloom.runtime import Scratch, share_code

CAPACITY = 4096
#: Lengths from capacity / LARGE on are grouped; smaller ones fill what is left.
LARGE = 8
#: Groups of equal cardinality.
GROUPS = 48
#: Most rounds of column generation; with fewer than it would take, a plan may need more sequences, and no document is lost.
ROUNDS = 400


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns, as counts of each size, and how often each is used; covers ``demand`` in few sequences."""
    k = len(sizes)
    d = np.array(demand, float)
    columns = [np.eye(k)[g] * (capacity // sizes[g]) for g in range(k)]
    for _ in range(ROUNDS):
        basis = np.column_stack(columns)
        price = np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for g, (size, p) in enumerate(zip(sizes, price.tolist(), strict=True)):
            for _ in range(capacity // size):
                with_it = best[: capacity + 1 - size] + p
                better = with_it > best[size:] + 1e-12
                if not better.any():
                    break
                best[size:][better], pick[size:][better] = with_it[better], g
        if best[capacity] <= 1 + 1e-7:
            break
        new, w = np.zeros(k), capacity
        while w > 0:
            if pick[w] < 0:
                break
            else:
                new[pick[w]] += 1
                w -= sizes[pick[w]]
        x, step = np.linalg.solve(basis, d), np.linalg.solve(basis, new)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[out] = new
    x = np.linalg.solve(np.column_stack(columns), d)
    left, found = list(demand), []
    for col, times in sorted(zip(columns, x, strict=True), key=lambda c: -c[1]):
        if (n := int(times + 1e-9)) > 0:
            found.append(([int(c) for c in col], n))
            left = [have - int(c) * n for have, c in zip(left, col, strict=True)]
    rest: list[list] = []  # first fit, longest first: at most a few documents a group are left
    for g in sorted(range(k), key=lambda g: -sizes[g]):
        for _ in range(max(0, left[g])):
            for r in rest:
                if r[0] >= sizes[g]:
                    break
            else:
                rest.append(r := [capacity, [0] * k])
            r[0] -= sizes[g]
            r[1][g] += 1
    return found + [(r[1], 1) for r in rest]


class Plan:
    """Runs of sequences for a histogram of lengths; entries are (length, first number, count, in a sequence, first sequence, offset).

    Without ``groups`` every length goes best-fit, longest first.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity, self.entries, self.sequences = capacity, [], 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: (first sequence, count)
        self.rooms: list[int] = []
        large = sorted((n for n in histogram if groups and n >= max(2, capacity // LARGE)), reverse=True)
        self._large([(n, histogram[n]) for n in large], groups)
        for n in sorted(set(histogram).difference(large), reverse=True):
            self._small(n, histogram[n])

    def _open(self, room: int, first: int, count: int) -> None:
        if room > 0:
            if not self.room[room]:
                bisect.insort(self.rooms, room)
            self.room[room].append((first, count))

    def _large(self, runs: list[tuple[int, int]], groups: int) -> None:
        total = sum(c for _, c in runs)
        if not total:
            return
        sizes, queues, demand, at = [], [], [], 0
        bounds = sorted({total * (g + 1) // min(groups, total) for g in range(min(groups, total))})
        queue: list[list[int]] = []
        used = dict.fromkeys((n for n, _ in runs), 0)
        pending = [list(r) for r in runs]
        for bound in bounds:
            need = bound - at
            at = bound
            queue = []
            while need:
                n, c = pending[0]
                t = min(need, c)
                queue.append([n, used[n], t])
                used[n] += t
                need -= t
                pending[0][1] -= t
                if not pending[0][1]:
                    pending.pop(0)
            if sizes and sizes[-1] == queue[0][0]:
                queues[-1] += queue
                demand[-1] += sum(q[2] for q in queue)
            else:
                sizes.append(queue[0][0])
                queues.append(queue)
                demand.append(sum(q[2] for q in queue))
        for pattern, times in configurations(sizes, demand, self.capacity):
            slots = []
            for g, times_in in enumerate(pattern):
                for _ in range(times_in):
                    slots.append(self._take(queues[g], times))
            self._substitute([s for s in slots if s], times)

    @staticmethod
    def _take(queue: list[list[int]], count: int) -> list[list[int]]:
        out = []
        while count and queue:
            n, first, c = queue[0]
            t = min(c, count)
            out.append([n, first, t])
            count -= t
            queue[0] = [n, first + t, c - t]
            if c == t:
                queue.pop(0)
        return out

    def _substitute(self, slots: list[list[list[int]]], times: int) -> None:
        """The places of ``times`` like sequences get documents; neighbours with like lengths stay one run."""
        left = times
        while left and any(slots):
            slots = [s for s in slots if s]
            t = min(s[0][2] for s in slots)
            offset = 0
            for s in slots:
                n, first, c = s[0]
                self.entries.append((n, first, t, 1, self.sequences, offset))
                offset += n
                s[0] = [n, first + t, c - t]
                if c == t:
                    s.pop(0)
            self._open(self.capacity - offset, self.sequences, t)
            self.sequences += t
            left -= t

    def _small(self, n: int, count: int) -> None:
        number = 0
        while count:
            at = bisect.bisect_left(self.rooms, n)
            if at == len(self.rooms):
                per = self.capacity // n
                times = max(1, count // per)
                first, room = self.sequences, self.capacity
                self.sequences += times
            else:
                room = self.rooms[at]
                first, times = self.room[room].pop()
                if not self.room[room]:
                    self.rooms.pop(at)
            per = min(room // n, count)
            used = min(times, count // per)
            if used < times:
                self._open(room, first + used, times - used)
            self.entries.append((n, number, used * per, per, first, self.capacity - room))
            self._open(room - per * n, first, used)
            number += used * per
            count -= used * per

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Sorted look-up key, and per in a sequence, first sequence, offset of each entry."""
        e = np.array(self.entries, np.int64).reshape(-1, 6)
        e = e[np.lexsort((e[:, 1], e[:, 0]))]
        return (e[:, 0] << 44) | e[:, 1], e[:, 1], e[:, 3], e[:, 4], e[:, 5]


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The plan by groups, or that by best fit alone where it has fewer sequences."""
    return min((Plan(histogram, capacity, g) for g in (groups, 0)), key=lambda p: p.sequences)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tokens and end token in pieces: id, piece, start, length, ids_crc32."""
    share_code(df.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in parts(batches):
            ids, at, _, _ = bpe.flat(part.column(1))
            sizes = np.diff(at) + 1  # with the end token
            count = -(-sizes // capacity)
            index = np.repeat(np.arange(len(sizes)), count)
            nth = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
            start, length = nth * capacity, np.minimum(sizes[index] - nth * capacity, capacity)
            own = np.minimum(length, sizes[index] - 1 - start)  # ids of a piece but for the end token
            raw, begin = memoryview(ids.astype("<u4", copy=False)).cast("B"), at[index] + start
            crc = [zlib.crc32(end if n < m else b"", zlib.crc32(raw[4 * a : 4 * (a + n)])) for a, n, m in zip(begin.tolist(), own.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index)), *map(pa.array, (nth.astype(np.int32), start, length, np.array(crc, np.int64)))], ["id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of ``df`` with ``sequence_id`` and ``offset``."""
    spark = df.sparkSession
    kept = Scratch(spark, "packing").keep(pieces(df, path, capacity, end_id, id_col, text_col), "pieces")
    # at most ``capacity`` rows
    plan = best_plan({r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity, groups)
    # entries: at most a few for each pair of a length and a group, whatever the number of documents
    key, number, per, first, offset = plan.arrays()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, nth = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, (n << 44) | nth, side="right") - 1
            k = nth - number[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first[at] + k // per[at]), pa.array(offset[at] + k % per[at] * n)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    told = numbered(kept, ["length"], ["id", "piece", "start", "ids_crc32"], "nth")
    return told.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op4_linear_grouping(spark, sf_dir: str) -> DataFrame:
    """``documents`` in sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
