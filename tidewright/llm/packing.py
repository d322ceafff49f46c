"""Shortest-pack-first packing over the length histogram.

Documents become pieces: whole sequences of ``size`` ids and one shorter tail each. Only the histogram of
piece lengths, at most ``size`` numbers whatever the input, reaches the driver. There, lengths are placed
longest first, each into the shortest packs that still hold it, on counts of equal packs rather than packs.
The resulting patterns are joined back to pieces by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import staged, table
from ._tokens import batches, default_vocabulary, encoder

SIZE, END_ID = 1024, 0
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank_in_task long"


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(packs, lengths of their pieces) for counts by length; a pattern's lengths sum to at most size.

    Longest pieces first, each goes into the shortest pack that has room for it, a new one if none has. Packs of one
    pattern are one group, split only when fewer pieces than packs are left: while a piece is laid in each pack of the
    group with most room, the others of it stay the shortest. Equal patterns are merged at the end. Counts may be of
    any magnitude: the work depends on the number of lengths.
    """
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def lay(room: int, packs: int, inside: tuple[int, ...]) -> None:
        if room not in groups:
            insort(rooms, room)
        groups[room].append((packs, inside))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            packs, inside = groups[room].pop()
            if not groups[room]:
                rooms.pop()
                del groups[room]
            used = min(packs, left)
            if packs > used:
                lay(room, packs - used, inside)
            lay(room - length, used, (*inside, length))
            left -= used
        if left:  # a new pack takes this length until it is full
            each = size // length
            whole, rest = divmod(left, each)
            if whole:
                lay(size - length * each, whole, (length,) * each)
            if rest:
                lay(size - length * rest, 1, (length,) * rest)
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs, inside in (x for room in sorted(groups) for x in groups[room]):
        merged[inside] += packs
    return [(n, inside) for inside, n in sorted(merged.items(), reverse=True)]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of runs, the sequence of each run's first piece, the offset in those sequences."""
    runs, sequence, taken = defaultdict(list), 0, defaultdict(int)
    for packs, inside in patterns:
        for length, offset in zip(inside, accumulate((0, *inside))):
            runs[length].append((taken[length], sequence, offset))
            taken[length] += packs
        sequence += packs
    return {length: tuple(np.array(x, np.int64) for x in zip(*r)) for length, r in runs.items()}


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every row of docs (doc_id, text), with their rank among the task's pieces of that length."""
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def cut(parts):
        encode, task, seen = encoder(path).encode, TaskContext.get().partitionId(), [0] * (size + 1)
        for part in parts:
            ids = part.column(0).to_pylist()
            for first, texts in batches(part.column(1)):
                out = []
                for k, got in enumerate(encode(texts)):
                    got += end
                    n = len(got) // 4
                    for start in range(0, n, size):
                        chunk = got[4 * start : 4 * (start + size)]
                        length = len(chunk) // 4
                        out.append((ids[first + k], start, length, zlib.crc32(chunk), n, task, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 5 else pa.int64()) for i, x in enumerate(zip(*out))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank_in_task"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    Null and empty texts are one piece of the end id; a text of any length is cut into as many pieces as it takes.
    Repeated rows are packed once each; pieces of equal length (ties) are ranked by task and order of reading. A null
    doc_id is kept. Other columns are not read, whatever their names. An empty table gives no rows. padded_length is
    what the sequence takes: its own length if that is a power of two, else size.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, size, end_id, vocabulary), "pieces")
    counts = staged(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    patterns = shortest_pack_first({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a row for each task and length grows with the tasks, so it is merged, not broadcast
    ranked = cut.join(bases.hint("merge"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("rank_in_task"))
    totals, at = [], 0
    for packs, inside in patterns:
        totals.append((at, sum(inside)))
        at += packs
    where = spark.sparkContext.broadcast((places(patterns), np.array([x[0] for x in totals], np.int64), np.array([x[1] for x in totals], np.int64)))

    def place(parts):
        runs, firsts, sums = where.value
        for part in parts:
            if not part.num_rows:
                continue
            length, rank = (part.column(i).to_numpy() for i in (2, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, begin = np.unique(length[order], return_index=True)
            for value, i, j in zip(values.tolist(), begin, [*begin[1:], len(order)]):
                rows = order[i:j]
                lows, sequences, offsets = runs[value]
                run = np.searchsorted(lows, rank[rows], side="right") - 1
                sequence[rows] = sequences[run] + rank[rows] - lows[run]
                offset[rows] = offsets[run]
            total = sums[np.searchsorted(firsts, sequence, side="right") - 1]
            padded = np.where(total & (total - 1) == 0, total, size)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(sequence), pa.array(offset), pa.array(padded)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
