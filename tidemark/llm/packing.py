"""Best-fit packing of token sequences (operator 7).

A document becomes its token ids and an end id; documents longer than the
capacity are cut so that all pieces but the first are full. Packing depends on
lengths alone, of which there are at most ``capacity``, so the plan is made on
the histogram: the driver holds one count per length however large the corpus
is. Pieces over a third of the capacity meet at most one other such piece in a
bin, found by greedy matching from the longest on; shorter ones go, longest
first, to the fullest bin that still takes them. Bins of one make-up are planned
together as (make-up, number), and each piece then finds its place from its rank
among the pieces of its length.

Defined results: a null text is the empty text (a piece of the end id alone); a
text of any length is cut whole; pieces of equal length are alike, and go to their
places in the order of partitions and rows; repeated rows are packed each for
itself, and ``doc_id`` may be null; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import bounded_batches, stage, text_of
from tidemark.llm._tokens import END_ID

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local_rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids: the first takes what does not fill a bin."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def match_and_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Plan bins for ``counts`` pieces of each length: (lengths in a bin, number of such bins)."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    open_bins: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by gap
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fit = bisect_left(large, capacity - n + 1) - 1  # the longest that fits beside n
        if fit < 0:
            items, number = [n], left[n]
            used = {n: number}
        elif large[fit] == n:
            number = left[n] // 2
            items, used = ([n, n], {n: 2 * number}) if number else ([n], {n: 1})
            if not number and len(large) > 1:  # the last of its length may pair with a shorter one
                other = large[-2]
                items, used = [n, other], {n: 1, other: 1}
            number = number or 1
        else:
            other = large[fit]
            number = min(left[n], left[other])
            items, used = [n, other], {n: number, other: number}
        open_bins[capacity - sum(items)].append((items, number))
        for k, c in used.items():
            left[k] -= c
            if not left[k]:
                large.remove(k)
    gaps = sorted(open_bins)
    for n in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        rest = left[n]
        while rest:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                items, number, gap = [], max(1, rest // (capacity // n)), capacity
            else:
                gap = gaps[at]
                items, number = open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap], gaps[at]
            each = min(gap // n, rest)
            filled = min(number, rest // each)
            if filled < number:
                _open(open_bins, gaps, gap, items, number - filled)
            _open(open_bins, gaps, gap - each * n, items + [n] * each, filled)
            rest -= filled * each
    return [(items, number) for bins in open_bins.values() for items, number in bins if items and number]


def _open(open_bins: dict, gaps: list[int], gap: int, items: list[int], number: int) -> None:
    if gap not in open_bins:
        insort(gaps, gap)
    open_bins[gap].append((items, number))


def place_table(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks of runs, and each run's first bin, slots per bin and offset of its first slot.

    A run holds the pieces of one length in bins of one make-up; pieces of equal
    length lie beside each other in a bin.
    """
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    next_rank: dict[int, int] = defaultdict(int)
    bin_id = 0
    for items, number in plan:
        offset = 0
        for n in sorted(set(items), reverse=True):
            slots = items.count(n)
            runs[n].append((next_rank[n], bin_id, slots, offset))
            next_rank[n] += slots * number
            offset += slots * n
        bin_id += number
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def cut_partition(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> pieces with their rank among the pieces of their length in this partition."""
    from pyspark import TaskContext

    from tidemark.llm._tokens import tokenizer

    encoder, part = tokenizer(path), TaskContext.get().partitionId()
    end = np.array([end_id], "<u4").tobytes()
    seen: dict[int, int] = defaultdict(int)
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), text_of(batch.column(1)), strict=True):
            packed = memoryview(encoder.ids(text) + end)
            start = 0
            for piece, n in enumerate(cut_lengths(len(packed) // 4, capacity)):
                rows.append((doc, piece, start, n, zlib.crc32(packed[4 * start : 4 * (start + n)]), part, seen[n]))
                seen[n] += 1
                start += n
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = END_ID) -> DataFrame:
    """Pack ``documents`` (doc_id, text); one row per piece with its bin and offset."""
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = stage(rows.mapInArrow(lambda b: cut_partition(b, tokenizer_path, capacity, end_id), PIECES), "pieces")
    return place(cut, capacity)


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """Give each piece of a staged table its bin, from counts per length."""
    spark = cut.sparkSession
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(place_table(match_and_fit(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            bins, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, edges):
                if len(rows):
                    n = int(length[rows[0]])
                    ranks, first_bin, slots, at = table[n]
                    run = np.searchsorted(ranks, rank[rows], "right") - 1
                    inside = rank[rows] - ranks[run]
                    bins[rows] = first_bin[run] + inside // slots[run]
                    offset[rows] = at[run] + inside % slots[run] * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(length.astype(np.int64)), batch.column(4), pa.array(bins), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut.join(first, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_rank") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(seat, PACKED)
