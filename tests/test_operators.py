import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import components, graph, lines, near_duplicates, relevance, reports, stats
from quarry.streaming import watch


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(3)
    pairs = {"random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)], "chain": [(i, i + 1) for i in range(50)], "star": [(0, i) for i in range(1, 40)], "empty": []}[shape]
    got = components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert {r.node: r.component for r in got.collect()} == want


def test_cycles(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(40)]
    reach = {n: {n} for n in range(25)}
    for _ in range(25):
        for a, b in edges:
            for r in reach.values():
                if a in r:
                    r.add(b)
    want = {}
    for n in range(25):
        group = [m for m in range(25) if m in reach[n] and n in reach[m]]
        if len(group) > 1:
            want[n] = (min(group), len(group))
    got = graph.cycles(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: (r.component, r.size) for r in got.collect()} == want


def test_impact_and_paths(spark):
    calls = spark.createDataFrame([("mid", "leaf"), ("top", "mid"), ("recA", "recB"), ("recB", "recA")], "caller string, callee string")
    assert {(r.symbol, r.depth) for r in graph.impact(calls, "leaf").collect()} == {("mid", 1), ("top", 2)}
    assert {(r.symbol, r.depth) for r in graph.impact(calls, "recA").collect()} == {("recB", 1)}
    assert [r.path for r in graph.call_path(calls, "top", "leaf").collect()] == ["top > mid > leaf"]
    assert graph.call_path(calls, "leaf", "top").collect() == []
    assert [r.path for r in graph.call_path(calls, "top", "top").collect()] == ["top"]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(20):
        base = [word() for _ in range(120)]
        texts.append(base)
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(1, 6)):
                copy[rng.randrange(120)] = word()
            texts.append(copy)
    rows = [(f"p{i:03}", len(t), " ".join(t)) for i, t in enumerate(texts)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "path string, size long, body string"), 0.85).collect()
    prints = [near_duplicates.simhash(t) for _, _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 1 - (prints[i] ^ prints[j]).bit_count() / 64 >= 0.85]
    roots = union_find(pairs)
    want = {}
    for i, r in roots.items():
        want.setdefault(r, set()).add(rows[i][0])
    have = {}
    for r in got:
        have.setdefault(r.group, set()).add(r.path)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values())) and have


@pytest.mark.parametrize(("threshold", "n"), [(0.85, 300), (0.85, 500_000), (0.85, 20_000_000), (0.92, 3_000_000), (0.6, 300), (1.0, 300)])
def test_similar_pairs_reach_no_driver_and_lose_none(spark, threshold, n):
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    flips = [sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 12), replace=False)) for _ in range(240)]
    prints = sorted({int(x) for x in base} | {int(base[i % 60]) ^ f for i, f in enumerate(flips)})
    table = spark.createDataFrame([(p,) for p in prints], "print long")
    pairs = near_duplicates.similar_pairs(table, threshold, n)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if 1 - bits(a, b) / 64 >= threshold}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    forest = {(r.a, r.b) for r in near_duplicates.similar_pairs(table, threshold, n, whole=False).collect()}
    groups = lambda found: {frozenset(x for x in prints if roots.get(x) == r) for roots in [union_find(found)] for r in roots.values()}
    assert forest <= want and groups(forest) == groups(want)


def test_links_of_a_large_cluster_are_a_forest():
    """Of 2 ** 10 fingerprints alike, half a million pairs, a task sends 1,023."""
    prints = np.arange(1 << 10).astype(np.int64)
    batch = near_duplicates.pa.RecordBatch.from_arrays([near_duplicates.pa.array(np.zeros(len(prints), np.int32)), near_duplicates.pa.array(prints)], names=["shard", "print"])
    sent = [list(near_duplicates._pairs(16, 16, 10, 10, whole, iter([batch]))) for whole in (True, False)]
    assert [sum(b.num_rows for b in x) for x in sent] == [1023 * 512, 1023] and max(b.num_rows for x in sent for b in x) <= near_duplicates.SENT


def test_simhash_definition():
    h = 14695981039346656037
    for b in b"one two six":
        h = (h ^ b) * 1099511628211 % (1 << 64)
    assert near_duplicates.simhash("One, two; SIX a") == h
    assert near_duplicates.simhash("one two") == 0
    data = np.frombuffer(b"ab", np.uint8)
    assert [int(x) for x in near_duplicates.fnv1a(data, np.array([0, 0, 1]), np.array([0, 1, 2]))] == [14695981039346656037, *((14695981039346656037 ^ b) * 1099511628211 % (1 << 64) for b in b"ab")]


def test_rounds_of_cycles_broadcast_nothing(spark, monkeypatch):
    plans = []

    def stored(df, *a, keep=graph.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, *a)

    monkeypatch.setattr(graph, "stored", stored)
    edges = [(i, i + 1) for i in range(20)] + [(20, 12), (5, 3), (30, 31), (31, 30), (40, 40)]
    got = {r.node: (r.component, r["size"]) for r in graph.cycles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: (3, 3) for i in (3, 4, 5)} | {i: (12, 9) for i in range(12, 21)} | {i: (30, 2) for i in (30, 31)}
    assert sum("Join" in p for p in plans) > 3 and not [p for p in plans if "Broadcast" in p]


def test_positions(spark):
    rng = np.random.default_rng(0)
    rows = [(f"p{i:04}", float(x)) for i, x in enumerate(rng.integers(0, 50, 500))]
    got = {r.path: r.position for r in relevance.positions(spark.createDataFrame(rows, "path string, s double"), "s").collect()}
    assert [p for p, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] == sorted(got, key=got.get)
    assert sorted(got.values()) == list(range(1, 501))


def test_bm25_prefers_both_terms(spark):
    rows = [("both", "red fox red fox jumps"), ("red", "red sun sets over hills"), ("fox", "quick brown fox runs home"), ("neither", "")]
    got = {r.path: r.bm25 for r in relevance.bm25(spark.createDataFrame(rows, "path string, body string"), "red fox").collect()}
    assert max(got, key=got.get) == "both" and got["neither"] == 0


def test_find_matches_edges(spark):
    files = spark.createDataFrame([("a", "x\nhit 1\nhit 2\nz\n", "python"), ("b", "# hit\nhit()\r\n", "python"), ("c", "", "go")], "path string, body string, language string")
    rows = [(r.path, r.line, r.text, r.before, r.after) for r in lines.find_matches(files, "hit", before=1, after=1).collect()]
    assert rows == [("a", 2, "hit 1", ["x"], ["hit 2"]), ("a", 3, "hit 2", ["hit 1"], ["z"]), ("b", 1, "# hit", [], ["hit()"]), ("b", 2, "hit()", ["# hit"], [])]
    assert [(r.path, r.line) for r in lines.find_matches(files, "hit", per_file=1).collect()] == [("a", 2), ("b", 1)]
    assert [(r.path, r.line) for r in lines.find_matches(files, "hit", role="comments").collect()] == [("b", 1)]


def test_loc_block_comments(spark):
    body = "package a\n\n/* one\ntwo */\n// three\nfunc f() {}\n"
    row = lines.loc(spark.createDataFrame([(body, "go")], "body string, language string")).first()
    assert (row.loc, row.comment_loc, row.blank_loc) == (2, 3, 1)


def test_duplicates_and_diff(spark):
    a = spark.createDataFrame([("shared", 2, "ss"), ("only_a", 2, "aa"), ("drift", 2, "d1"), ("empty", 0, "")], "path string, size long, body string")
    b = spark.createDataFrame([("shared", 2, "ss"), ("only_b", 2, "bb"), ("drift", 2, "d2"), ("empty", 0, "")], "path string, size long, body string")
    assert {r.path_a for r in stats.diff(a, b, "a-minus-b").collect()} == {"only_a", "drift"}
    assert {r.path_b for r in stats.diff(a, b, "b-minus-a").collect()} == {"only_b", "drift"}
    assert [r.path_a for r in stats.diff(a, b, "mismatch").collect()] == ["drift"]
    assert stats.diff(a, b, "union").count() == 5
    both = stats.duplicates(a.unionByName(b.withColumn("path", F.concat(F.lit("b/"), "path")))).collect()
    assert [(r["count"], r.wasted, list(r.paths)) for r in both] == [(2, 2, ["b/shared", "shared"])]


def test_reports(spark):
    functions = spark.createDataFrame([("m", "covered", 1, 10), ("m", "uncovered", 11, 300), ("m", "none", 400, 410)], "path string, function string, start_line int, end_line int")
    blocks = spark.createDataFrame([("m", 2, 2, True), ("m", 12, 1, False), ("m", 200, 1, False)], "file string, start_line int, num_stmt int, covered boolean")
    got = reports.coverage_gaps(functions, blocks).collect()
    assert [(r.function, r.total, r.covered) for r in got] == [("uncovered", 2, 0)]
    now = spark.createDataFrame([("a", "f", 20), ("a", "g", 5)], "path string, symbol string, value int")
    assert reports.verdict(reports.review(now, now)).first().verdict == "warn"
    assert reports.verdict(reports.review(now, now.limit(0))).first().verdict == "fail"


def test_watch_stream(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(user_id as string) path", "ts", "case when event_id % 7 = 0 then 'delete' else 'write' end op", "event_id size")
    folder = str(tmp_path / "in")
    source.repartition(3).write.parquet(folder)
    stream = watch.watch(watch.read_stream(spark, folder, source.schema), "size > 10")
    query = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").count() == source.where("size > 10").count()
    index = watch.keep_index(watch.read_stream(spark, folder, source.schema), str(tmp_path / "index"), str(tmp_path / "ck"))
    index.awaitTermination(60)
    kept = spark.read.parquet(str(tmp_path / "index" / "v0"))
    last = source.groupBy("path").agg(F.max_by("op", "ts").alias("op")).where("op <> 'delete'")
    assert kept.count() == last.count()


def test_debounce_keeps_latest(spark):
    rows = [("a", "2024-01-01 00:00:00.0", "create"), ("a", "2024-01-01 00:00:00.2", "write"), ("a", "2024-01-01 00:00:01.0", "write"), ("b", "2024-01-01 00:00:00.1", "create")]
    events = spark.createDataFrame(rows, "path string, t string, op string").selectExpr("path", "to_timestamp_ntz(t) ts", "op")
    got = sorted((r.path, r.op, r.events) for r in watch.debounce(events).collect())
    assert got == [("a", "write", 1), ("a", "write", 2), ("b", "create", 1)]


def test_chunks_reach_the_end_of_a_long_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(70_001))
    rows = sorted(lines.chunks(spark.createDataFrame([("a", text)], "path string, body string"), 1000).collect(), key=lambda r: r.chunk_id)
    assert [r.start for r in rows] == [875 * k for k in range(len(rows))]
    assert rows[0].text + "".join(r.text[125:] for r in rows[1:]) == text
    assert lines.chunks(spark.createDataFrame([("a", text)], "path string, body string"), 1000, 64).count() == 64


def test_chat_body_has_late_and_unnumbered_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 10_000, "user", "late"), (1, None, "system", "none"), (2, None, "user", "b"), (3, 20_000, "user", "c"), (None, 1, "user", "d")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.message_count, r.body) for r in stats.chat_summary(turns).collect()}
    assert got == {1: (3, "user\ta\nuser\tlate\nsystem\tnone"), 2: (1, "user\tb"), 3: (1, "user\tc"), None: (1, "user\td")}


@pytest.mark.parametrize("bound", [10, 1_000_000])
def test_components_by_broadcast_and_by_shuffle(spark, monkeypatch, bound):
    """A hub, a chain and small groups, with and without room for a broadcast of all keys."""
    from quarry import runtime
    from quarry.operators import components

    monkeypatch.setattr(runtime, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(runtime, "HOT", 5)
    edges = [(5, i) for i in range(1000, 1400)] + [(i, i + 1) for i in range(2000, 2060)] + [(3000 + 2 * i, 3001 + 2 * i) for i in range(50)] + [(7, 7), (None, 1)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    roots = union_find([(a, b) for a, b in edges if a is not None and a != b])
    least = {}
    for n, r in roots.items():
        least[r] = min(least.get(r, n), n)
    assert got == {n: least[r] for n, r in roots.items()}
