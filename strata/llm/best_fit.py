"""Packing by bulk-synchronous best fit: as few sequences of ``length`` tokens as it can.

A document's ids end with id 0.  Longer documents are cut into pieces of ``length`` ids, the first of
which may be shorter; whole pieces are sequences, all others are items to place.  State is two stored tables:
items (size) without a place and open sequences (gap).  A round is

1. range sort: items and gaps together are range-partitioned by size, largest first, a gap before the items of
   its size, then by number, so a size that a third of all rows share is split evenly;
2. successor sweep: each task goes down its range once and gives every item the smallest gap of its range that
   holds it; what is left of a gap is a gap again;
3. across ranges: an item that found none takes the smallest gap left over by the ranges above, so the ranges' left-over
   counts (two numbers a range) are matched like brackets on the driver and become segments of ranks: the r-th
   left-over item of a range meets the s-th left-over gap of another, by a join on (range, rank).  Ranks are
   unique, so no gap is taken twice;
4. items of highest rank that still have none open new sequences, as many as the volume left over needs at the least;
5. gaps are updated, placed items are written, and the next round goes on with the rest.

Rounds end when no item is left; there are about as many as a sequence has items.  Once the rest fits one range, its sweep also opens sequences where no gap holds an
item, which is best fit decreasing.  A range holds about ``range_rows`` rows, whatever the input.

Defined results.  Null or empty text: the single id 0.  Null doc_id: kept, as null.  Repeated rows are packed
one by one.  Texts of any length are cut.  Empty table: no pieces.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, remove, slices, store, table
from .packing import RANKS, VOCABULARY
from .tokens import whole_text

LENGTH = 2048
RANGE_ROWS = 50_000
OWN_SEQUENCE = 1 << 62

_CUT = "number long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
_CUT_ARROW = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def cut(docs: DataFrame, path: str, ranks: str, length: int) -> DataFrame:
    """The pieces of all documents with a number of their own; ids are little-endian and 32 bits each."""

    def work(batches):
        model, number = whole_text(path, ranks), TaskContext.get().partitionId() << 36
        for b in slices(batches, 2 << 20):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(model.encode(text or ""), 0).astype("<u4")
                start, piece = 0, 0
                while start < len(ids):
                    end = start + (len(ids) - start - 1) % length + 1  # what is not a multiple comes first
                    raw = ids[start:end].tobytes()
                    rows.append((number, doc, piece, start, end - start, zlib.crc32(raw), raw))
                    number, start, piece = number + 1, end, piece + 1
            yield batch(_CUT_ARROW, *zip(*rows))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, _CUT)


# What a sweep reports of an item or gap.
PLACED, ITEM_LEFT, GAP_LEFT, GAP_USED = 0, 1, 2, 3
_SWEPT = "kind int, number long, size long, sequence long, offset long, part int, rank long"
_SWEPT_ARROW = pa.schema([("kind", pa.int32()), ("number", pa.int64()), ("size", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])


def sweep(rows, length: int, part: int, first_sequence: int | None):
    """One range, largest first: (is_item, number, size) -> rows of ``_SWEPT``.

    ``first_sequence``: the range is all there is, so items without a gap open sequences from this number on."""
    gaps: dict[int, list[tuple[int, bool]]] = {}  # by size: sequences, and whether they took an item in this sweep
    sizes: list[int] = []  # of the gaps, ascending
    out, waiting, least = [], 0, 0
    for is_item, number, size in rows:
        least = size
        if not is_item:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((number, False))
            continue
        i = bisect_left(sizes, size)
        if i < len(sizes):
            gap = sizes[i]
            sequence, _ = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[i]
        elif first_sequence is not None:
            gap, sequence = length, first_sequence
            first_sequence += 1
        else:
            out.append((ITEM_LEFT, number, size, None, None, part, waiting))
            waiting += 1
            continue
        out.append((PLACED, number, size, sequence, length - gap, part, None))
        rest = gap - size
        if rest:
            if rest not in gaps:
                gaps[rest] = []
                insort(sizes, rest)
            gaps[rest].append((sequence, True))
    rank = 0
    for size in reversed(sizes):
        for sequence, used in gaps[size]:
            # a gap smaller than this range's least size may be too small for the ranges below
            if size >= least:
                out.append((GAP_LEFT, None, size, sequence, None, part, rank))
                rank += 1
            elif used:
                out.append((GAP_USED, None, size, sequence, None, part, None))
    return out


def swept(state: DataFrame, ranges: int, length: int, first_sequence: int) -> DataFrame:
    order = [F.desc("size"), "is_item", "number"]
    alone = ranges == 1
    dealt = state.coalesce(1) if alone else state.repartitionByRange(ranges, *order)

    def work(batches):
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = sweep(rows, length, part, first_sequence if alone else None)
        for i in range(0, len(out), 65536):
            yield batch(_SWEPT_ARROW, *zip(*out[i : i + 65536]))

    return dealt.sortWithinPartitions(*order).select("is_item", "number", "size").mapInArrow(work, _SWEPT)


def bracket_match(counts: dict[int, tuple[int, int]], new: int) -> tuple[list, list, int]:
    """Match the ranges' left-over items with the gaps left over above them.

    ``counts``: per range its left-over (items, gaps), ranges in order of falling size.  Returns segments
    (range of items, first rank, last rank + 1, range of gaps, rank of the first item's gap; ranks of gaps fall),
    segments of new sequences (range, first rank, last rank + 1, how many were opened before), and how many were opened.
    """
    stack: list[list[int]] = []  # [range, gaps still free]; those of highest rank are the smallest
    segments, opened, used = [], [], 0
    for part in sorted(counts):
        items, gaps = counts[part]
        rank = 0
        while rank < items and stack:
            take = min(items - rank, stack[-1][1])
            segments.append((part, rank, rank + take, stack[-1][0], stack[-1][1] - 1))
            rank += take
            stack[-1][1] -= take
            if not stack[-1][1]:
                stack.pop()
        if rank < items and used < new:
            take = min(items - rank, new - used)
            opened.append((part, rank, rank + take, used))
            used += take
        if gaps:
            stack.append([part, gaps])
    return segments, opened, used


def carry(left: DataFrame, length: int, new: int, first_sequence: int) -> tuple[DataFrame, int]:
    """Left-over items with the gap or new sequence they get, the rest of both without, as rows of ``_SWEPT``."""
    spark = left.sparkSession
    counts: dict[int, list[int]] = {}
    for r in left.filter(F.col("kind").isin(ITEM_LEFT, GAP_LEFT)).groupBy("part", "kind").count().collect():  # two numbers a range
        counts.setdefault(r["part"], [0, 0])[r["kind"] - 1] = r["count"]
    segments, opened, used = bracket_match(counts, new)
    table_ = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in segments] + [(a, b, c, -1, d) for a, b, c, d in opened], "part int, low long, high long, gap_part int, gap_rank long")
    own = F.broadcast(table_)  # at most three rows a range
    items = left.filter(F.col("kind") == ITEM_LEFT).alias("i")
    found = items.join(own.alias("s"), (F.col("i.part") == F.col("s.part")) & (F.col("i.rank") >= F.col("s.low")) & (F.col("i.rank") < F.col("s.high")), "left")
    step = F.col("i.rank") - F.col("s.low")
    found = found.select("i.number", "i.size", F.col("s.gap_part").alias("part"), F.when(F.col("s.gap_part") >= 0, F.col("s.gap_rank") - step).otherwise(F.col("s.gap_rank") + step).alias("rank"))
    gaps = left.filter(F.col("kind") == GAP_LEFT).select("part", "rank", "sequence", F.col("size").alias("gap"))
    # a gap of its own, a new sequence, or neither
    both = found.filter("part >= 0").join(gaps, ["part", "rank"], "full")
    both = both.select("number", "size", "sequence", "gap")
    fresh = found.filter("part < 0").select("number", "size", (F.col("rank") + F.lit(first_sequence)).alias("sequence"), F.lit(length).cast("long").alias("gap"))
    none = found.filter("part IS NULL").select("number", "size", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("long").alias("gap"))
    return both.unionByName(fresh).unionByName(none), used


def place(items: DataFrame, length: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """number, sequence, offset of every item (number, size)."""
    spark = items.sparkSession
    state = store(items.select(F.lit(True).alias("is_item"), "number", F.col("size").cast("long").alias("size")), "fit-state")
    placed, sequences, parts = [], 0, []
    slow = False
    while True:
        n = state.agg(
            *(F.count(F.when(c, 1)).alias(a) for a, c in (("items", F.col("is_item")), ("gaps", ~F.col("is_item")), ("big", F.col("is_item") & (F.col("size") > length // 2)), ("wide", ~F.col("is_item") & (F.col("size") > length // 2)))),
            F.coalesce(F.sum(F.when(F.col("is_item"), F.col("size"))), F.lit(0)).alias("volume"), F.coalesce(F.sum(F.when(~F.col("is_item"), F.col("size"))), F.lit(0)).alias("free"),
        ).first()
        if not n["items"]:
            break
        ranges = -(-(n["items"] + n["gaps"]) // range_rows)
        round_ = store(swept(state, ranges, length, sequences), "fit-sweep")
        if ranges == 1:
            placed.append(round_.filter(F.col("kind") == PLACED).select("number", "sequence", "offset"))
            remove(state)
            break
        least = max(-(-(n["volume"] - n["free"]) // length), n["big"] - n["wide"], 0)
        if slow:
            least = max(least, -(-n["volume"] // length))
        rest, opened = carry(round_, length, least, sequences)
        rest = store(rest, "fit-carry")
        sequences += opened
        done = F.col("number").isNotNull() & F.col("gap").isNotNull()
        placed += [round_.filter(F.col("kind") == PLACED).select("number", "sequence", "offset"), rest.filter(done).select("number", "sequence", (F.lit(length) - F.col("gap")).alias("offset"))]
        after = rest.select(
            F.col("gap").isNull().alias("is_item"),
            F.when(F.col("gap").isNull(), F.col("number")).otherwise(F.col("sequence")).alias("number"),
            F.when(F.col("gap").isNull(), F.col("size")).otherwise(F.col("gap") - F.coalesce("size", F.lit(0))).alias("size"),
        ).filter("size > 0")
        used = round_.filter(F.col("kind") == GAP_USED).select(F.lit(False).alias("is_item"), F.col("sequence").alias("number"), "size")
        remove(state)
        state = store(after.unionByName(used), "fit-state")
        left = state.filter("is_item").count()
        # hardly a gap took an item: what is left doesn't fit them
        slow = n["gaps"] > 0 and n["items"] - left - opened < 0.1 * n["gaps"]
    if not placed:
        return spark.createDataFrame([], "number long, sequence long, offset long")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack_best_fit(docs: DataFrame, path: str, ranks: str, length: int = LENGTH, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset of every piece."""
    pieces = store(cut(docs, path, ranks, length), "fit-pieces", "zstd")
    whole = pieces.filter(F.col("length") == length).withColumn("sequence_id", F.col("number") + F.lit(OWN_SEQUENCE)).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.filter(F.col("length") < length)
    places = place(short.select("number", F.col("length").alias("size")), length, range_rows)
    short = short.join(places.withColumnRenamed("sequence", "sequence_id"), "number")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    return whole.select(columns).unionByName(short.select(columns))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)).drop("ids")


QUERIES = {"op13_best_fit": op13_best_fit}
ORACLE: dict[str, str] = {}
