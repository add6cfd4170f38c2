import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, simhash_dedup


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return groups


def test_exact_duplicates(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a "), (7, "x" * 100_000), (8, "x" * 100_000), (None, "b"), (9, "é"), (9, "é")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, whole string").repartition(3)
    got = exact_dedup.exact_duplicates(docs).collect()
    groups = exact(rows)
    assert len(got) == len(rows)
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        keep = max(x for x in own if x is not None)
        assert (r.keep_id, r.group_size) == (keep, len(own)) and (r.doc_id == keep or not r.kept)
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.deduplicate(docs).collect()
    assert sorted((r.doc_id, r.text or "", r.whole) for r in left) == sorted((max(x for x in g if x is not None), t, "z") for t, g in groups.items())
    for run in (exact_dedup.exact_duplicates, exact_dedup.deduplicate):
        assert run(docs.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [1, 9])
def test_filter_misses_no_repeat(spark, monkeypatch, parts):
    """Each row is tested once, by the one filter of its part; filters are of one size however many rows there are."""
    if parts > 1:
        monkeypatch.setattr(exact_dedup, "MAX_SLOTS", 6000)
        monkeypatch.setattr(exact_dedup, "SEGMENT", 1 << 10)
    assert exact_dedup.filter_parts(3250)[0] == parts
    rng = random.Random(4)
    values = [rng.getrandbits(63) for _ in range(3000)]
    values += values[:200] + values[:50]
    rng.shuffle(values)
    built, build = [], exact_dedup.repeated_filter
    monkeypatch.setattr(exact_dedup, "repeated_filter", lambda own, slots: built.append((own.count(), slots)) or build(own, slots))
    rows = spark.createDataFrame([(v, str(v)) for v in values], "hash long, name string").repartition(7)
    got = exact_dedup.flagged(rows, len(values)).collect()
    found = [r.hash for r in got if r.twice]
    repeated = [v for v in values if values.count(v) > 1]
    assert sorted((r.hash, r.name) for r in got) == sorted((v, str(v)) for v in values)
    assert sorted(v for v in found if values.count(v) > 1) == sorted(repeated)
    assert len(found) < len(repeated) + 300
    assert len(built) == parts and sum(n for n, _ in built) == len(values) and len({s for _, s in built}) == 1 and built[0][1] <= max(1 << 13, exact_dedup.SEGMENT)


def test_exact_duplicates_in_parts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = [sorted(map(tuple, run(docs).collect())) for run in (exact_dedup.exact_duplicates, exact_dedup.deduplicate)]
    monkeypatch.setattr(exact_dedup, "MAX_SLOTS", 1024)
    monkeypatch.setattr(exact_dedup, "SEGMENT", 1 << 10)
    assert exact_dedup.filter_parts(docs.count())[0] > 3
    assert [sorted(map(tuple, run(docs).collect())) for run in (exact_dedup.exact_duplicates, exact_dedup.deduplicate)] == whole


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


TEXTS = ["", None, "One", "one TWO", "one two THREE", "a b c d e f", "É è\xa0x y\x0bz", "w " * 500, "  lead and trail\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash_dedup.fingerprint((text or "").encode()) == brute_print(text)


def components(prints, distance):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_near_duplicates_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()}
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    want = components(prints, 3)
    assert got == {i: (prints[i], want[i]) for i in prints}


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5])
def test_links_against_all_pairs(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:
        for n in range(7):
            prints.add(b ^ sum(1 << k for k in rng.sample(range(64), n)))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "print long"), distance).collect()
    have = {frozenset((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1)) for r in got}
    assert have == {frozenset((a, b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance}


def test_near_duplicate_edges(spark):
    rows = [(5, None), (3, " "), (None, ""), (8, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "other words here")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, print int")
    got = sorted(((r.doc_id, r.component_id, r.class_size) for r in simhash_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3, 3), (3, 3, 3), (None, 3, 3), (8, 2, 3), (2, 2, 3), (2, 2, 3), (9, 9, 1)], key=str)
    assert sorted(r.doc_id or 0 for r in simhash_dedup.deduplicate(docs).collect()) == [0, 2, 2, 3, 9]
    assert simhash_dedup.near_duplicates(docs.limit(0)).collect() == []
    named = docs.withColumnRenamed("print", "gone")
    assert sorted(r.doc_id or 0 for r in simhash_dedup.deduplicate(named).collect()) == [0, 2, 2, 3, 9]


def test_candidates_are_few(spark):
    """Random fingerprints hardly meet: a cell has both the counts and the bits of its part."""
    rng = random.Random(3)
    prints = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(20_000)], "print long")
    plan = simhash_dedup.links(prints)
    assert plan.count() == 0


def test_fingerprint_sql():
    """The SQL's XXH64 over texts of all lengths up to 130 characters and some longer ones."""
    import duckdb
    import pyarrow as pa

    from quarry.llm import queries

    rng = random.Random(1)
    rows = [None, "", " \t\n", "A b", "One two Three", "É ß日本 \x0bA", *("".join(rng.choice("abcdéXYZ  ") for _ in range(n)) for n in [*range(1, 130), 500, 1000])]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(rows))), "text": rows}))
    for doc_id, fingerprint, *_ in con.execute(queries.SQL["op4_simhash_near_dedup"]).fetchall():
        assert int(fingerprint, 16) == brute_print(rows[doc_id])
