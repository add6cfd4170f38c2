"""SimHash near-duplicate files and functions: union of all pairs at a similarity, with representatives.

Tokens are lower-case letter or digit runs of two or more; three in a row make a
shingle; FNV-1a-64 of the shingles votes on each bit.  Two files are alike from
1 - hamming / 64 >= threshold on.  No pair is lost: with at most k differing
bits, one of m parts of the bits has at most k // m, so all whose parts lie that
near are compared.  More and wider parts take more steps but compare fewer;
plan() weighs both for the number of fingerprints at hand.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.operators.components import connected_components
from quarry.runtime import stored

THRESHOLD, SOURCE_THRESHOLD = 0.85, 0.92
_FNV_START, _FNV_PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)
_WORD = re.compile(r"[^\W_]+")
#: Shingles that are hashed at a time, and characters of texts.
SLICE, CHARS = 1 << 16, 8 << 20
#: Bits of a part by which fingerprints are told apart, at most, and those that deal them to tasks.
WIDEST, SHARD_BITS = 20, 4
#: Pairs that are compared at a time, and those that are sent at a time.
COMPARED, SENT = 1 << 18, 1 << 16


def fnv1a(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """FNV-1a-64 of the stretches of *data*, one column of bytes at a time."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    h, starts, lengths = np.full(len(starts), _FNV_START), starts[order], lengths[order]
    n = len(h)
    for i in range(int(lengths.max(initial=0))):
        while n and lengths[n - 1] <= i:
            n = int(np.searchsorted(-lengths[:n], -i, "left"))
        h[:n] = (h[:n] ^ data[starts[:n] + i]) * _FNV_PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def simhashes(texts: list[str]) -> np.ndarray:
    """The fingerprints of *texts*; 0 where there is no shingle.  Words of all texts are hashed together, SLICE shingles at a time."""
    words = [[w for w in _WORD.findall(t.lower()) if len(w) >= 2] for t in texts]
    number = np.fromiter((max(len(w) - 2, 0) for w in words), np.int64, len(words))
    flat = [w for own in words if len(own) > 2 for w in own]
    data = " ".join(flat).encode()
    sizes = np.fromiter(map(len, flat) if len(data) == sum(map(len, flat)) + max(len(flat) - 1, 0) else (len(w.encode()) for w in flat), np.int64, len(flat))
    ends = np.cumsum(sizes + 1) - 1
    begins, data = ends - sizes, np.frombuffer(data, np.uint8)
    # shingles that begin with the last two words of a text are none
    first = np.ones(len(flat), bool)
    stops = np.cumsum(np.where(number > 0, number + 2, 0))[number > 0]
    first[stops - 1] = first[stops - 2] = False
    at = np.flatnonzero(first)
    owner = np.repeat(np.arange(len(texts)), number)
    total = np.zeros((len(texts), 64), np.int64)
    for k in range(0, len(at), SLICE):
        part, own = at[k : k + SLICE], owner[k : k + SLICE]
        h = fnv1a(data, begins[part], ends[part + 2])
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        votes = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total[own[heads]] += np.add.reduceat(votes, heads, axis=0, dtype=np.int64)
    return np.packbits(total * 2 > number[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def simhash(text: str) -> int:
    return int(simhashes([text])[0])


_COMMENT = re.compile(r"^\s*(//|#|/\*|\*|--|;|\"\"\"|''')")
_HEAD = re.compile(r"^\s*(package|import|from|use|using|require|#include)\b|^\s*[()]\s*$|^\s*\"[^\"]*\"\s*$")


def without_head(source: str) -> str:
    """Source text (null as it is) without its leading comments and blank lines and its package and import lines."""
    if not source:
        return source
    lines = source.split("\n")
    k = 0
    while k < len(lines) and (not lines[k].strip() or _COMMENT.match(lines[k]) or _HEAD.match(lines[k])):
        k += 1
    return "\n".join(lines[k:])


def _prints(batches):
    for batch in batches:
        bodies = [(without_head(x) if s else x) or "" for x, s in zip(batch.column("body").to_pylist(), batch.column("is_source").to_pylist())]
        found, start, held = [], 0, 0
        for i, x in enumerate(bodies):
            held += len(x)
            if held >= CHARS or i + 1 == len(bodies):
                found.append(simhashes(bodies[start : i + 1]))
                start, held = i + 1, 0
        out = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size"), pa.array(out.view(np.int64))], names=["path", "size", "print"])


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, size, print) of files with a signal; print is the bit pattern of a long."""
    source = F.col("content_type").startswith("source/") if "content_type" in files.columns else F.lit(False)
    rows = files.select(F.col("path"), F.col("size").cast("bigint").alias("size"), "body", F.coalesce(source, F.lit(False)).alias("is_source"))
    return rows.mapInArrow(_prints, "path string, size bigint, print bigint").where("print <> 0")


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def plan(k: int, n: int) -> tuple[int, int]:
    """By how many parts of the 64 bits, and how many bits of each, *n* random fingerprints at most *k* bits apart are found soonest.

    Weighs about 1 ns for a pair that is compared against the steps for each value of a part and its tasks.
    """

    def cost(plan: tuple[int, int]) -> float:
        m, width = plan
        ball = _ball(width, k // m)
        return m * (0.1 + min(n, 2**width) * (4e-5 + 1.5e-7 * ball) + ball / 2.0**width * n * n / 2 * 1e-9)

    return min(((m, w) for m in range(1, min(k + 1, 64 // SHARD_BITS) + 1) for w in range(SHARD_BITS, min(64 // m, WIDEST) + 1)), key=cost)


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for r in range(1, min(radius, width) + 1) for bits in itertools.combinations(range(width), r)], np.int64)


def _alike(prints: np.ndarray, at: int, width: int, radius: int, most: int, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) in *prints*, in pieces, of pairs at most *most* bits apart; *prints* are in the order of the part.

    The part is the *width* bits from *at* on.  Found are the pairs whose lesser
    part begins with the bits *shard* and has at most *radius* bits other than the greater.
    """
    value = (prints >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
    starts = np.searchsorted(value, np.arange((1 << width) + 1))
    masks = _masks(width, radius)
    for v in np.unique(value[value >> (width - SHARD_BITS) == shard]).tolist():
        near = v ^ masks
        near = np.r_[v, near[near > v]]
        begins = starts[near]
        sizes = starts[near + 1] - begins
        there = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        for c in range(0, len(there), COMPARED):
            other = there[c : c + COMPARED]
            met = prints[other]
            step = max(1, COMPARED // len(other))
            for i in range(int(starts[v]), int(starts[v + 1]), step):
                own = prints[i : min(i + step, int(starts[v + 1]))]
                hit = np.flatnonzero(np.bitwise_count(own[:, None] ^ met) <= most)
                if len(hit):
                    left, right = hit // len(other) + i, other[hit % len(other)]
                    later = right > left
                    if later.any():
                        yield left[later], right[later]


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    root = parent[i]
    while True:
        up = parent[root]
        if (up == root).all():
            parent[i] = root
            return root
        root = up


def _joining(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the links (left, right) those that join trees of *parent*, which then are one; so a forest is all that comes."""
    while len(left):
        a, b = _roots(parent, left), _roots(parent, right)
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        upper, first = np.unique(np.maximum(a, b), return_index=True)
        parent[upper] = np.minimum(a, b)[first]
        if len(first):
            yield left[first], right[first]


def _pairs(width: int, step: int, radius: int, most: int, whole: bool, batches):
    """(a, b) of the fingerprints in the shards of a task, whose rows are (shard, print)."""
    held = defaultdict(list)
    for batch in batches:
        shard, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        for s in np.unique(shard).tolist():
            held[s].append(prints[shard == s])
    kept, n = [], 0
    for s in list(held):
        part, shard = divmod(s, 1 << SHARD_BITS)
        prints = np.concatenate(held.pop(s))
        prints = prints[np.argsort((prints >> np.uint64(part * step)) & np.uint64((1 << width) - 1), kind="stable")]
        found = _alike(prints, part * step, width, radius, most, shard)
        parent = None if whole else np.arange(len(prints))
        for left, right in found if whole else (x for pair in found for x in _joining(parent, *pair)):
            kept.append(np.stack([prints[left].view(np.int64), prints[right].view(np.int64)]))
            n += len(left)
            if n >= SENT:
                yield from _sent(kept)
                kept, n = [], 0
    yield from _sent(kept)


def _sent(kept: list[np.ndarray]):
    if kept:
        both = np.concatenate(kept, axis=1)
        for i in range(0, both.shape[1], SENT):
            one = both[:, i : i + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(one.min(axis=0)), pa.array(one.max(axis=0))], names=["a", "b"])


def similar_pairs(prints: DataFrame, threshold: float, n: int, whole: bool = True) -> DataFrame:
    """(a, b) of the *n* distinct fingerprints that are alike; each pair may come several times.

    Not *whole*, only pairs that link all that is linked come: at most one for
    each fingerprint of a task, however large its clusters are.

    The first SHARD_BITS bits of each part deal the fingerprints to tasks, and to
    those of lesser bits that are near enough to hold a partner: at 0.85 about 20
    copies, whatever their number.  No join could send them to the driver, and a
    task holds its copies only.  What is compared is a fixed share of all pairs:
    0.8 % with 9 bits and four parts of 16.
    """
    k = max((d for d in range(65) if 1 - d / 64.0 >= threshold), default=0)
    m, width = plan(k, n)
    step, radius, shards = 64 // m, k // m, 1 << SHARD_BITS
    each = []
    for i in range(m):
        own = f"cast(shiftrightunsigned(print, {i * step + width - SHARD_BITS}) & {shards - 1} as int)"
        each.append(f"transform(filter(sequence(0, {own}), s -> bit_count(s ^ {own}) <= {radius}), s -> s + {i * shards})")
    dealt = prints.select(F.explode(F.expr(f"concat({', '.join(each)})")).alias("shard"), "print").repartitionById(m * shards, F.col("shard"))
    return dealt.mapInArrow(functools.partial(_pairs, width, step, radius, k, whole), "a bigint, b bigint")


def near_duplicates(files: DataFrame, threshold: float | None = None) -> DataFrame:
    """(group, path, size, similarity, is_representative, members) of all groups of two or more files.

    The representative is the largest file, of equals the first path; similarity
    is to it.  Without a *threshold* it is 0.85, or 0.92 where more than half of
    the files are source.
    """
    if threshold is None:
        share = files.agg(F.avg(F.col("content_type").startswith("source/").cast("double"))).first()[0] if "content_type" in files.columns else 0
        threshold = SOURCE_THRESHOLD if (share or 0) > 0.5 else THRESHOLD
    prints = stored(fingerprints(files), "prints")
    classes = stored(prints.groupBy("print").agg(F.count("*").alias("n")), "classes")
    pairs = stored(similar_pairs(classes.select("print"), threshold, classes.count(), whole=False).distinct(), "pairs")
    linked = connected_components(pairs, "a", "b")
    groups = classes.join(linked, classes["print"] == linked["node"], "left").select("print", F.coalesce("component", "print").alias("root"), "n")
    members = groups.groupBy("root").agg(F.sum("n").alias("members")).where("members > 1")
    rows = prints.join(groups.join(members, "root").select("print", "root", "members"), "print")
    best = rows.groupBy("root").agg(F.min(F.struct((-F.col("size")).alias("minus"), "path", "print")).alias("r"))
    met = rows.join(best, "root")
    similarity = 1 - F.bit_count(F.col("print").bitwiseXOR(F.col("r.print"))) / F.lit(64.0)
    return met.select(F.col("r.path").alias("group"), "path", "size", similarity.alias("similarity"), (F.col("path") == F.col("r.path")).alias("is_representative"), "members")


def duplicate_functions(spans: DataFrame, threshold: float = SOURCE_THRESHOLD, least: int = 5) -> DataFrame:
    """As near_duplicates over function spans (path, symbol, lines, body) of *least* lines or more; the longest span stands for a group."""
    named = spans.where(F.col("lines") >= least).select(F.concat_ws("#", "path", "symbol").alias("path"), F.col("lines").cast("bigint").alias("size"), "body", F.lit("").alias("content_type"))
    return near_duplicates(named, threshold)


def ordered(groups: DataFrame, most: int = 20) -> DataFrame:
    """Members by falling similarity, then path; at most *most* of each group."""
    w = Window.partitionBy("group").orderBy(F.col("similarity").desc(), "path")
    return groups.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
