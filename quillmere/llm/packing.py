"""Packing of token pieces into fixed-length sequences: shortest-pack-first over the length histogram.

Only the histogram of piece lengths (at most ``capacity`` rows) comes to the driver. Lengths are
placed longest first, each into the open patterns with the most room (the shortest packs), and
counts of packing patterns are updated rather than packs one by one. Patterns then become intervals of ranks for each
length, and a piece finds its sequence and offset by its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, map_text, only, written
from .tokens import SLICE, text_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids (null text: only end_id) cut every ``capacity`` ids: doc_id, start, length,
    ids_crc32, doc_tokens and, with with_ids, the ids themselves."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = text_ids(batch.column("text"), vocabulary, end_id, added=True)
        total = np.diff(offsets)
        count = -(-total // capacity)
        row = np.repeat(np.arange(len(total)), count)
        start = gathered(np.zeros(len(total), np.int64), count) * capacity
        length = np.minimum(capacity, total[row] - start)
        low = offsets[row] + start
        raw = memoryview(ids.astype("<i4", copy=False)).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(low.tolist(), length.tolist(), strict=True)]
        columns = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(total[row])]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, offsets[-1]).astype(np.int32)), pa.array(ids, pa.int32())))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return map_text(only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")), run, PIECES + ", ids array<int>" * with_ids, slice_bytes=SLICE)


def packing_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(packs, ((length, pieces of it), ...)) for each pattern: together they hold every piece once.

    Longest lengths are placed first, into the packs with the most room that are open; packs of one
    pattern take as many pieces of the length as fit, and only packs that none of a length fits
    close it off. New packs open when no open one has room."""
    open_by_room: list[tuple[int, int]] = []  # (-room, pattern number)
    patterns: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
    number = 0

    def put(count: int, held: tuple[tuple[int, int], ...], room: int) -> None:
        nonlocal number
        if count:
            patterns[number] = (count, held)
            heapq.heappush(open_by_room, (-room, number))
            number += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # Too little room for this length may be enough for shorter ones; the heap keeps them in order.
        while left:
            if open_by_room and -open_by_room[0][0] >= length:
                room, pattern = -open_by_room[0][0], heapq.heappop(open_by_room)[1]
                count, held = patterns.pop(pattern)
                # One piece to each pack of the pattern, or to as many packs as there are pieces: the
                # shortest pack is then another one. When it stays the shortest it takes more at once.
                rival = -open_by_room[0][0] if open_by_room else 0
                each = max(1, min(room // length, (room - rival) // length if rival < room else 1, max(1, left // count)))
                if left >= count * each:
                    put(count, (*held, (length, each)), room - length * each)
                    left -= count * each
                else:
                    put(count - left, held, room)
                    put(left, (*held, (length, 1)), room - length)
                    left = 0
            else:
                each = capacity // length
                full, rest = divmod(left, each)
                put(full, ((length, each),), capacity - length * each)
                put(1 if rest else 0, ((length, rest),), capacity - length * rest)
                left = 0
    return [patterns[k] for k in sorted(patterns)]


def rank_intervals(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[str, np.ndarray]:
    """Intervals of ranks by length: pieces of ``length`` with rank first <= r < next first lie in
    sequence ``sequence`` + (r - first) at ``offset``. Sorted by length, then first."""
    rows, taken, base = [], {}, 0
    for count, held in patterns:
        offset = 0
        for length, pieces in held:
            for _ in range(pieces):
                first = taken.get(length, 0)
                rows.append((length, first, base, offset))
                taken[length] = first + count
                offset += length
        base += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack_pieces(pieces: DataFrame, capacity: int = 4096, rows_per_block: int = 50_000) -> DataFrame:
    """pieces with sequence_id and offset added. Each length must be 1 to capacity; nulls raise an error.

    Ranks count within blocks of pieces that a hash deals out, so one length that many pieces share is
    ranked by many tasks; equal pieces take their ranks in any order, with the same result. The
    intervals sent to the executors are bounded by the histogram: each step of the packing adds at most two patterns."""
    spark = pieces.sparkSession
    table = pieces if hasattr(pieces, "_quillmere_path") else written(pieces, "pieces")
    total = table.count()
    blocks = max(1, -(-total // rows_per_block))
    table = table.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)).cast("int"))
    counts = table.groupBy("length", "block").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(x is None or not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    sent = spark.sparkContext.broadcast(rank_intervals(packing_patterns(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "block", "base")
    local = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = table.withColumn("rank", F.row_number().over(local)).join(bases, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("base"))

    def place(batches):
        x = sent.value
        heads = np.flatnonzero(np.append(True, x["length"][1:] != x["length"][:-1])) if len(x["length"]) else np.empty(0, np.int64)
        # One sorted key for (length, first): firsts of a length lie below the next length's.
        span = int(x["first"].max(initial=0)) + total + 1
        key = np.searchsorted(x["length"][heads], x["length"]) * span + x["first"]
        for batch in batches:
            length = np.asarray(batch.column("length"), dtype=np.int64)
            rank = np.asarray(batch.column("rank"), dtype=np.int64)
            i = np.searchsorted(key, np.searchsorted(x["length"][heads], length) * span + rank, side="right") - 1
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(x["sequence"][i] + rank - x["first"][i]), pa.array(x["offset"][i])], [*kept, "sequence_id", "offset"])

    columns = [c for c in table.columns if c != "block"]
    out = ranked.select(*columns, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != "rank")
    return out.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, **options) -> DataFrame:
    """Pieces of all documents with their sequence and offset in it. A null or empty text is one piece of the end id alone; null
    and repeated ids stay, their pieces each; an empty table gives none; other columns play no part."""
    return pack_pieces(written(token_pieces(docs, vocabulary, capacity, end_id, **options), "pieces"), capacity)
