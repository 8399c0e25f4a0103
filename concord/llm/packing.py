"""Best-fit packing of token sequences.

Best-fit decreasing needs only how many pieces there are of each length. The
plan is made on that histogram (at most ``size`` rows, whatever the corpus): a
segment tree over the remaining capacities 0..size finds the tightest open bin
for a length in logarithmic time, and bins alike are filled together, in runs.
A run says where the next ``count`` pieces of a length go: into bins numbered
from ``sequence``, ``per`` in each, from ``offset`` on.

Pieces are numbered within their length by (task, place in the task): each task
counts its pieces, the counts are added up over tasks by a window of one row a
task and length, and runs are looked up by that number. No piece is moved to be
ranked, and no length, however common, meets in one task.

Defined results: a null text is an empty one, and its piece holds the end id
alone; repeated rows are packed each; an empty table gives no rows; a text of
exactly ``size`` ids is one piece. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, default_vocabulary, encoder, scratch, stored, table, tune_batches

SIZE, END_ID = 2048, 0


class CapacityTree:
    """Which capacities have open bins; the least one that is enough, in O(log n)."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [False] * (2 * self.leaves)

    def put(self, capacity: int, there: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = there
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least need that has an open bin."""
        i = need + self.leaves
        if self.open[i]:
            return need
        while i > 1 and (i & 1 or not self.open[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, per sequence, offset)."""
    runs, tree, bins, made = [], CapacityTree(size), defaultdict(list), 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = size, size // length
                many = -(-left // per)
                first, made = made, made + many
            else:
                per = room // length
                first, many = bins[room].pop()
                if not bins[room]:
                    tree.put(room, False)
                need = -(-left // per)
                if many > need:
                    _reopen(bins, tree, room, first + need, many - need)
                    many = need
            put = min(left, many * per)
            runs.append((length, rank, put, first, per, size - room))
            full, rest = divmod(put, per)
            _reopen(bins, tree, room - per * length, first, full)
            if rest:
                _reopen(bins, tree, room - rest * length, first + full, 1)
            left, rank = left - put, rank + put
    return runs


def _reopen(bins: dict, tree: CapacityTree, room: int, first: int, many: int) -> None:
    if many and room:
        bins[room].append((first, many))
        tree.put(room, True)


def cut(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and where it was made: task and rank (of its length in the task)."""
    end = struct.pack("<I", end_id)

    def run(frames):
        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for b in batches(frames):
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    n = len(part) // 4
                    for c, v in zip(cols, (doc_id, piece, at // 4, n, zlib.crc32(part), seen[n]), strict=True):
                        c.append(v)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            arrays.insert(5, pa.array(np.full(len(arrays[0]), task), pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, folder: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces with the sequence and the offset that each has."""
    spark = docs.sparkSession
    tune_batches(spark)
    pieces = stored(cut(docs, vocabulary, size, end_id), f"{folder}/pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, size)
    runs.sort(key=lambda r: (r[0], r[1]))
    held = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 6))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(frames):
        r = held.value
        key = r[:, 0] << 44 | r[:, 1]
        for b in batches(frames):
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = r[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - at[:, 1]
            per = at[:, 4]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(at[:, 3] + nth // per), pa.array(at[:, 5] + nth % per * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary(), scratch(spark, "packing"))
