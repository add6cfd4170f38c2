"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents form blocks.  With a weight of a slots in D, block j of
a source may go no earlier than slot floor(j D / a) and must go before slot
ceil((j + 1) D / a); earliest deadline first then gives every block a slot in
its window, so in each prefix of the schedule every source has its due share to
within one block.  The schedule repeats after D slots, so only one period is
worked out, from the weights alone; where a block of the corpus goes is then
plain arithmetic on its number.  When a source runs out, the schedule goes on
with the weights of those that are left: each such phase has a period of its own.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.runtime import BROADCAST_ROWS, bounded, run_dir, shuffle_partitions, stored

#: Documents of one source in a row.
BLOCK = 16
#: Slots of a period when weights come from the corpus, at least, and for each source.
PERIOD, SOURCE_SLOTS = 1000, 8
#: Parts of a source that are ranked apart; a source of any size is spread over so many groups.
SHARDS = 4096
#: Numbers of the schedule that go into the plan as a literal at most; a longer one is stored as a table, so many at a time.
SCHEDULE_ROWS = 200_000


def period(shares: list[int], left: list[int] | None = None) -> list[tuple[int, int]]:
    """(source number, block number) of each slot of one period of sum(*shares*) slots, by earliest deadline first.

    With *left*, the blocks of each source, it ends with the slot in which a source runs out.
    """
    total = sum(shares)
    release = lambda s, j: j * total // shares[s]
    waiting = [(0, s, 0) for s in range(len(shares))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // shares[s]), s, j))
        due, s, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError(f"block {j} of source {s} is late")
        slots.append((s, j))
        if left is not None and j + 1 == left[s]:
            break
        if j + 1 < shares[s]:
            heapq.heappush(waiting, (release(s, j + 1), s, j + 1))
    return slots


def phases(shares: list[int], blocks: list[int]) -> Iterator[dict]:
    """The phases of a schedule: base slot, slots, period, the source that runs out, and for each source in it (first block, first block after it, share, slots).

    A source's slots are those of one period, or of the phase where that is shorter.
    """
    left, base, done = list(blocks), 0, [0] * len(blocks)
    active = [s for s in range(len(blocks)) if left[s] > 0]
    while active:
        own = [shares[s] for s in active]
        g = math.gcd(*own)
        own = [a // g for a in own]
        total = sum(own)
        at = [array("q") for _ in own]
        for t, (k, _) in enumerate(period(own, [left[s] for s in active])):
            at[k].append(t)
        # the slot after the last block of the source that runs out first; one whose slots were not worked out so far runs out later
        ends = [(((left[s] - 1) // a) * total + at[k][(left[s] - 1) % a] + 1, s) for k, (s, a) in enumerate(zip(active, own)) if (left[s] - 1) % a < len(at[k])]
        length, ended = min(ends)
        full, rest = divmod(length, total)
        used = {s: full * a + bisect_left(at[k], rest) for k, (s, a) in enumerate(zip(active, own))}
        yield {"base": base, "length": length, "period": total, "ended": ended, "first": {s: done[s] for s in active}, "until": {s: done[s] + used[s] for s in active}, "share": dict(zip(active, own)), "at": dict(zip(active, at))}
        for s, n in used.items():
            left[s] -= n
            done[s] += n
        base += length
        active = [s for s in active if left[s] > 0]


def corpus_shares(counts: list[int], temperature: float, slots: int = PERIOD) -> list[int]:
    """Whole shares in proportion to counts ** temperature, one at least, by largest remainders."""
    slots = max(slots, SOURCE_SLOTS * len(counts))
    raw = [n**temperature for n in counts]
    exact = [x * slots / sum(raw) for x in raw]
    shares = [max(1, int(x)) for x in exact]
    for i in sorted(range(len(raw)), key=lambda i: (int(exact[i]) - exact[i], i))[: max(0, slots - sum(shares))]:
        shares[i] += 1
    return shares


def _small(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table of few *rows* as a literal of the plan."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(x.replace(' ', ':') for x in schema.split(', '))}>>")))


def _schedule(spark: SparkSession, shares: list[int], blocks: list[int], gaps: list[int]) -> tuple[DataFrame, int, int]:
    """All phases of all sources, the number of such rows, and that of all slots in them.

    Rows: number, width, stretch, phase, first, until (blocks), base, period, share, gap, at.  A source's blocks are dealt
    into stretches of *width* blocks, about as many as it has phases; a phase is there for each stretch it touches.
    *gaps* has what each source's last block lacks: it is the last of its phase, so all later phases move up by it.
    """
    schema = "number int, stretch bigint, phase int, first bigint, until bigint, base bigint, period bigint, share bigint, gap bigint, at array<bigint>"
    alive = {s: k + 1 for k, s in enumerate(sorted(range(len(blocks)), key=lambda s: blocks[s] / max(shares[s], 1)))}
    rows, held, steps, spans, path, gap = [], 0, 0, 0, None, 0
    width = [_width(b, alive[s]) for s, b in enumerate(blocks)]
    for p, f in enumerate(phases(shares, blocks)):
        for s, at in f["at"].items():
            if held > SCHEDULE_ROWS:
                path = path or f"{run_dir(spark)}/schedule-{uuid.uuid4().hex}"
                _small(spark, schema, rows).write.mode("append").parquet(path)
                rows, held = [], 0
            first, until = f["first"][s], f["until"][s]
            if until == first:
                continue
            for stretch in range(first // width[s], (until - 1) // width[s] + 1):
                rows.append((s, stretch, p, first, until, f["base"], f["period"], f["share"][s], gap, at.tolist() if stretch == first // width[s] else None))
                held += 10
                spans += 1
            held += len(at)
            steps += len(at)
        gap += gaps[f["ended"]]
    if path is None:
        return _small(spark, schema, rows), spans, steps
    _small(spark, schema, rows).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path), spans, steps


def _width(blocks: int, phases_at_most: int) -> int:
    return max(1, -(-blocks // phases_at_most))


def mix(docs: DataFrame, *, shares: dict | None = None, temperature: float = 0.5, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", into: str = "mix") -> DataFrame:
    """*docs*, each row once, with a struct column *into*: target_weight, phase, block, release, deadline, slot, position.

    *shares* gives each source a whole number of slots (a source without one gets
    1); without it shares go with a source's number of rows to the power
    *temperature*.  A source's rows are in an order that depends on a hash of their
    ids, so it is mixed in itself; *block* of them make a block (the last may be
    shorter).  position numbers the rows of the whole mix from 0 without gaps.

    Nothing is dropped or repeated: sources that run out leave their slots to the
    others, in proportion.  A null source is a source; rows of equal or null id
    count each.  An empty table gives no rows.  Columns may have any names; one
    named *into* is replaced.

    Rows move once, by source and shard, and then meet tables of the schedule:
    by broadcast up to BROADCAST_ROWS rows, else by shuffle.  Give only the columns
    that are needed: all given ones move.  The driver sees one number per source
    and per shard of it, and works out one period per phase, or the phase where
    that is shorter: never more slots than there are blocks, and with weights from
    the corpus about SOURCE_SLOTS / 2 times the square of the number of sources.
    It holds one phase and SCHEDULE_ROWS numbers of the schedule at a time.
    """
    spark, columns = docs.sparkSession, docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    whole = docs.select(row.alias("row"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("id"))
    # by a hash of the id; null ids are spread by what else their rows hold
    hashed = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    whole = whole.withColumn("tie", F.xxhash64("id", "row")).withColumn("shard", F.pmod(F.coalesce(hashed, F.col("tie")), F.lit(SHARDS)).cast("int"))
    shard_rows = stored(whole.groupBy("source", "shard").agg(F.count("*").alias("n")), "shards")
    sizes = sorted(((r.source is None, r.source, r.n) for r in shard_rows.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0], x[1] or ""))
    names, counts = [x[1] for x in sizes], [x[2] for x in sizes]
    if shares is None:
        share = corpus_shares(counts, temperature) if counts else []
    else:
        share = [int(shares.get(n, 1)) for n in names]
    blocks = [-(-n // block) for n in counts]
    schedule, n_spans, n_steps = _schedule(spark, share, blocks, [-n % block for n in counts])
    spans, steps = schedule.drop("at"), schedule.where("at is not null").select("number", "phase", F.posexplode("at").alias("step", "at"))

    alive = {s: k + 1 for k, s in enumerate(sorted(range(len(blocks)), key=lambda s: blocks[s] / max(share[s], 1)))}
    sources = _small(spark, "number int, name string, target_weight double, width bigint", [(s, n, share[s] / sum(share), _width(blocks[s], alive[s])) for s, n in enumerate(names)])
    numbered = lambda df: df.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")
    # where a source's shards begin among its rows
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(numbered(shard_rows).select("number", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "begins")
    ranked = numbered(whole).withColumn("rank", F.row_number().over(Window.partitionBy("number", "shard").orderBy("id", "tie")) - 1)
    ranked = ranked.join(bounded(begins), ["number", "shard"])
    ranked = ranked.withColumn("index", F.col("begin") + F.col("rank")).withColumn("block", F.floor(F.col("index") / block)).withColumn("stretch", F.expr("block div width"))
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    ranked = ranked.join(few(spans, n_spans), ["number", "stretch"]).where("block >= first and block < until")
    ranked = ranked.withColumn("j", F.expr("block - first")).withColumn("step", F.expr("j % share"))
    ranked = ranked.join(few(steps, n_steps), ["number", "phase", "step"])
    ranked = ranked.withColumn("slot", F.expr("base + (j div share) * period + at"))
    release, deadline = F.expr("base + (j * period) div share"), F.expr("base + ((j + 1) * period + share - 1) div share")
    position = F.col("slot") * block + F.col("index") % block - F.col("gap")
    made = F.struct("target_weight", "phase", "block", release.alias("release"), deadline.alias("deadline"), "slot", position.alias("position"))
    return ranked.select("row", made.alias("made")).select(*(F.col(f"row.`{c}`") for c in columns if c != into), F.col("made").alias(into))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of *docs* in the order of the mix: partitions are stretches of it, each sorted; the columns are those of *docs*."""
    into = "mix"
    while into in docs.columns:
        into += "_"
    mixed = mix(docs, into=into, **options)
    at = F.col(f"{into}.position")
    return mixed.repartitionByRange(shuffle_partitions(docs.sparkSession), at).sortWithinPartitions(at).drop(into)


def read_order(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """*columns* of *docs*, read from the Parquet files that in_order's rows were written to, with ``mix_part`` and ``mix_row``: sorted by both they are in the order of the mix.

    Only *columns* are read, so others may have any names.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    return docs.select(*(F.col(f"`{c}`") for c in columns), part.alias("mix_part"), F.col("_metadata.row_index").alias("mix_row"))
