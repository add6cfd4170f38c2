"""Best-fit packing of token sequences, certified by lower bounds and repacked across partitions."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import chunk_tokens
from quarry.runtime import shuffle_partitions, stored

#: Partitions whose open documents meet in one task of the next round.
FAN_IN = 16
#: A bin with more free space than this part of it is open even where its partition meets the bound.
SLACK = 64
#: Documents that one repacking task takes, about: a pool with more is dealt to several tasks, by bins.
REPACK_ROWS = 1_000_000
#: Texts that are tokenized at a time take at most so many UTF-8 bytes (or are one text): a pass holds some 15 times its bytes.
PASS_BYTES = 4 << 20
#: Pieces that are packed together where the order of the documents counts, and how often one may wait for the next stretch.
STRETCH, CARRY = 512, 4

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECES}, level int, part bigint, bin bigint, offset bigint, open boolean, pool bigint"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every size, and the fill of every bin.

    Longest first, each into the fullest bin that takes it.  Open bins are kept
    by free space, with one bit per free space that occurs, so the tightest bin
    is found by the lowest set bit: O(n log n) for the sort, then O(1) an item.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, fill = 0, []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, capacity - room
        fill[b] += n
        if room > n:
            if not free[room - n]:
                some |= 1 << (room - n)
            free[room - n].append(b)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing of *sizes* has fewer bins: the best of two families of dual feasible functions.

    First x -> 0 below e, x up to 1-e, 1 above, for each e up to 1/2 (e = 0 is
    the plain volume); then x -> floor((k+1)x)/k, or x where (k+1)x is whole,
    for k from 1 to 20.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    volume = np.cumsum(count * np.arange(capacity + 1))
    number = np.cumsum(count)
    e = np.arange(0, capacity // 2 + 1)
    below = np.where(e > 0, volume[e - 1], 0)
    bound = (number[-1] - number[capacity - e]) * capacity + volume[capacity - e] - below
    best = int(-(-bound.max() // capacity))
    x = np.arange(capacity + 1)
    for k in range(1, 21):
        steps, rest = np.divmod((k + 1) * x, capacity)
        # in units of 1 / (k * capacity)
        value = np.where(rest == 0, k * x, steps * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (k * capacity))))
    return best


def _still_open(bins: np.ndarray, fill: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Which documents the next round gets: of a partition with a gap, all in bins with room; else those in bins with room for more than SLACK."""
    gap = len(fill) > lower_bound(sizes, capacity)
    return fill[bins] < capacity if gap else capacity - fill[bins] > capacity // SLACK


def _pieces(path: str, capacity: int, closing: int, batches):
    """(doc_id, piece, start, length, ids_crc32) arrays of the documents of *batches*, a slice of them at a time."""
    for batch in batches:
        texts = batch.column("text")
        for a, b in chunk_tokens.slices(texts, PASS_BYTES):
            ids, ends = chunk_tokens.encode_texts(path, texts.slice(a, b - a), closing)
            ids = ids.astype("<u4", copy=False)
            begins = np.concatenate(([0], ends[:-1]))
            n = -(-(ends - begins) // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum((ends - begins)[row] - start, capacity)
            at = begins[row] + start
            crc = np.fromiter((zlib.crc32(ids[p:q]) for p, q in zip(at.tolist(), (at + length).tolist())), np.int64, len(at))
            yield batch.column("doc_id").slice(a, b - a).take(pa.array(row)), piece, start, length, crc


def _rows(pieces: tuple, part: int, bins: np.ndarray, offsets: np.ndarray, more: np.ndarray) -> pa.Table:
    """PLACED rows of level 0."""
    arrays = [pieces[0], pa.array(pieces[1], pa.int32()), *pieces[2:5], pa.array(np.zeros(len(bins)), pa.int32()), np.full(len(bins), part), bins, offsets, more, np.full(len(bins), part // FAN_IN)]
    names = [x.split()[0] for x in PLACED.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 3, pa.bool_(), pa.int64()]
    return pa.table([pa.array(x, t) if isinstance(x, np.ndarray) else x for x, t in zip(arrays, types)], names=names)


def _joined(several: list[tuple]) -> tuple:
    return (pa.concat_arrays([x[0] for x in several]), *(np.concatenate(x) for x in list(zip(*several))[1:]))


def _first_round(path: str, capacity: int, closing: int):
    def pack(batches):
        part = TaskContext.get().partitionId()
        several = list(_pieces(path, capacity, closing, batches))
        if not several:
            return
        pieces = _joined(several)
        bins, offsets, fill = best_fit_decreasing(pieces[3], capacity)
        yield from _rows(pieces, part, bins, offsets, _still_open(bins, fill, pieces[3], capacity)).to_batches(max_chunksize=100_000)

    return pack


def _dealt(found, stretch: int):
    """The pieces of all of *found* in order, *stretch* at a time (at the end fewer), however many came together."""
    left = None
    for several in found:
        left = several if left is None else _joined([left, several])
        whole = len(left[1]) // stretch * stretch
        for a in range(0, whole, stretch):
            yield tuple(x[a : a + stretch] for x in left)
        left = tuple(x[whole:] for x in left)
    if left is not None and len(left[1]):
        yield left


def _stretches(path: str, capacity: int, closing: int, stretch: int):
    """As _first_round, but *stretch* pieces at a time, in order; those of bins with room wait for the next, CARRY times at most."""

    def pack(batches):
        part, done, held = TaskContext.get().partitionId(), 0, None
        for new in _dealt(_pieces(path, capacity, closing, batches), stretch):
            new = (*new, np.zeros(len(new[1]), np.int64))
            held = new if held is None else _joined([held, new])
            bins, offsets, fill = best_fit_decreasing(held[3], capacity)
            waited = np.zeros(len(fill), np.int64)
            np.maximum.at(waited, bins, held[5])
            close = (capacity - fill <= capacity // SLACK) | (waited >= CARRY)
            go = close[bins]
            some = tuple(x.filter(pa.array(go)) if isinstance(x, pa.Array) else x[go] for x in held)
            yield from _rows(some, part, (done + np.cumsum(close) - 1)[bins[go]], offsets[go], np.zeros(int(go.sum()), bool)).to_batches()
            done += int(close.sum())
            held = tuple(x.filter(pa.array(~go)) if isinstance(x, pa.Array) else x[~go] for x in held)
            held[5][:] += 1
        if held is not None and len(held[1]):
            bins, offsets, fill = best_fit_decreasing(held[3], capacity)
            yield from _rows(held, part, done + bins, offsets, _still_open(bins, fill, held[3], capacity)).to_batches()

    return pack


def _repack(capacity: int, level: int):
    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pool, deal, deals = (int(x) for x in key)
        pdf = pdf.sort_values(["level", "part", "bin", "offset"], kind="stable")
        sizes = pdf["length"].to_numpy()
        bins = pdf.groupby(["level", "part", "bin"], sort=False).ngroup().to_numpy()
        offsets, fill = pdf["offset"].to_numpy(), np.bincount(bins, sizes).astype(np.int64)
        found = best_fit_decreasing(sizes, capacity)
        saved = len(fill) - len(found[2])
        if saved > 0:
            bins, offsets, fill = found
        # bins of a pool's tasks are numbered in turn
        return pdf.assign(level=np.int32(level), part=pool, bin=bins * deals + deal, offset=offsets, open=_still_open(bins, fill, sizes, capacity), pool=pool // FAN_IN, saved=np.int64(max(saved, 0)))

    return again


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text and then *closing*; only a longer one
    than *capacity* is cut.  Each partition packs its own documents by best fit
    decreasing and compares its bins with a lower bound from dual feasible
    functions.  Partitions above their bound send the documents of bins with
    room, and the others those of bins with more than a little, to a common task
    of FAN_IN partitions, which packs them anew and keeps the better packing; that
    repeats until one pool has seen all that is open.  Only ids and lengths
    travel, never texts.  A pool of more than REPACK_ROWS documents is dealt to
    several tasks, by bins; when the last pool is, it is dealt anew each round
    until a round saves less than a bin a task, so a task's memory is bounded at every
    size and no case stops the exchange early.

    With *order*, columns to sort by, each task packs a range of the documents,
    STRETCH pieces at a time, and sequence_id rises with the order: pieces that
    wait for a better fit come up to CARRY stretches later, and those that a task
    has over at its end follow the FAN_IN (or a power of it) partitions they met in.

    A null text is empty (one id), a null doc_id stays null, repeated rows are
    packed each, an empty table gives no rows; other columns are not read.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(order or [])))
    first = _first_round(path, capacity, closing)
    if order:
        by = [f"__{i}" for i in range(len(order))]
        kept = kept.repartitionByRange(shuffle_partitions(docs.sparkSession), *by).sortWithinPartitions(*by).drop(*by)
        first = _stretches(path, capacity, closing, STRETCH)
    placed = stored(kept.mapInArrow(first, PLACED), "placed")
    parts = [placed.where(~F.col("open"))]
    waiting, level = placed.where("open"), 0
    while True:
        sizes = {r.pool: r["count"] for r in waiting.groupBy("pool").count().collect()}
        if not sizes:
            break
        level += 1
        deals = {pool: -(-n // REPACK_ROWS) for pool, n in sizes.items()}
        many = F.lit(1)
        if max(deals.values()) > 1:
            many = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pool, k in deals.items() if k > 1 for x in (pool, k))), F.col("pool")), F.lit(1))
        dealt = waiting.withColumn("deals", many.cast("long")).withColumn("deal", F.pmod(F.xxhash64("level", "part", "bin", F.lit(level)), F.col("deals")))
        out = dealt.groupBy("pool", "deal", "deals").applyInPandas(_repack(capacity, level), f"{PLACED}, deals bigint, deal bigint, saved bigint")
        out = stored(out, "repacked")
        parts.append(out.where(~F.col("open")).drop("deals", "deal", "saved"))
        waiting = out.where("open").drop("deals", "deal", "saved")
        if len(sizes) == 1 and 0 in sizes:
            tasks = deals[0]
            saved = out.groupBy("deal").agg(F.first("saved").alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
            if tasks == 1 or saved < tasks:
                break
    whole = waiting
    for part in parts:
        whole = whole.unionByName(part)
    sequence = F.shiftleft(F.col("level").cast("long"), 57) + F.shiftleft(F.col("part"), 33) + F.col("bin")
    if order:
        last = (F.col("part") + 1) * F.pow(F.lit(FAN_IN), F.least(F.col("level"), F.lit(6))).cast("long") - 1
        sequence = F.shiftleft(last, 39) + F.shiftleft(F.col("level").cast("long"), 33) + F.col("bin")
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")
