import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import licenses, mixing, winnowing


def signed64(text, seed=42):
    h = xxhash.xxh64_intdigest(text.encode(), seed)
    return h - (1 << 64) if h >> 63 else h


def brute_tokens(text):
    text = re.sub("([฀-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff])", r" \1 ", text)
    plain = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text) if x]
    return [t for x in plain for t in (x if len(x) > 32 else [x])]


def brute_winnow(text, k=5, w=4):
    """(hash, position) of every kept run, each run hashed afresh by its polynomial."""
    prime, base = (1 << 31) - 1, 1_103_515_245
    tokens = brute_tokens(text or "")
    if not tokens:
        return []
    nums = [signed64(x) % prime for x in tokens]
    runs = []
    for i in range(max(len(nums) - k + 1, 1)):
        h = 0
        for x in nums[i : i + k]:
            h = (h * base + x) % prime
        runs.append(h)
    kept = []
    for i in range(max(len(runs) - w + 1, 1)):
        window = runs[i : i + w]
        least = min(window)
        at = i + max(j for j, x in enumerate(window) if x == least)
        if (least, at) not in kept[-w:]:
            kept.append((least, at))
    if len(text) < 64:
        # the hash of a second column takes that of the first as its seed
        seed = xxhash.xxh64_intdigest(b"short", 42)
        kept += [(signed64(text[i : i + 3], seed) % prime, -1 - i) for i in range(max(len(text) - 2, 1))]
    return kept


def test_winnowing_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    got = {r.doc_id: r for r in winnowing.fingerprints(docs).collect()}
    for r in docs.collect():
        want = brute_winnow(r.text)
        assert list(got[r.doc_id].hashes) == [h for h, _ in want]
        assert list(got[r.doc_id].positions) == [p for _, p in want]


@pytest.mark.parametrize("text", ["", None, " \n", "one", "a a a a a a a a a a a a", "a b c d e f g", "x" * 33 + " " + "y" * 32, "日本語 の文章abc です" * 9, " ".join(map(str, range(67))), " ".join(map(str, range(68))), " ".join(map(str, range(69))), " ".join(map(str, range(70_000)))])
def test_winnowing_edges(spark, text):
    docs = spark.createDataFrame([(1, text, "kept")], "doc_id long, text string, words string")
    row = winnowing.fingerprints(docs).first()
    assert list(zip(row.hashes, row.positions)) == brute_winnow(text)


def test_shared_runs_are_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    shared = [word() for _ in range(winnowing.K + winnowing.W - 1)]
    texts = [" ".join([word() for _ in range(30)] + shared + [word() for _ in range(30)]) for _ in range(6)]
    rows = winnowing.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    common = set(rows[0].hashes)
    for r in rows[1:]:
        common &= set(r.hashes)
    assert common


def test_edited_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in winnowing.edited_fingerprints(docs).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, r in enumerate(rows):
        following = rows[(i + 1) % len(rows)].text
        m = len(r.text) // 3
        edited = r.text[: len(r.text) - m] + following[:m]
        g = got[r.doc_id]
        own, changed, near = ({h for h, _ in brute_winnow(t)} for t in (r.text, edited, following))
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
        assert g.fingerprint.split() == [str(h) for h, _ in brute_winnow(r.text)] and g.positions.split() == [str(p) for _, p in brute_winnow(r.text)]
        assert g.edited_positions.split() == [str(p) for _, p in brute_winnow(edited)]
        assert abs(g.near_edited - jaccard(own, changed)) < 1e-9 and abs(g.near_next - jaccard(own, near)) < 1e-9


def test_edited_edges(spark):
    docs = spark.createDataFrame([(None, "n one two", 1), (4, None, 1), (4, "four", 1), (9, "nine nine nine", 1), (2, "", 1)], "doc_id long, text string, next_text int")
    got = {(r.doc_id, r.n_chars): r for r in winnowing.edited_fingerprints(docs).collect()}
    assert len(got) == 5
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[9, 14].edited_sha256 == sha("nine nine ") and got[4, 4].edited_sha256 == sha("fou") and got[None, 9].edited_sha256 == sha("n one nin")
    assert got[9, 14].near_edited > 0.3 and got[4, 4].near_edited == 0.25
    assert got[4, 0].near_edited == 1.0 and got[2, 0].near_next == 0.0
    assert winnowing.edited_fingerprints(docs.limit(0)).collect() == []
    alone = winnowing.edited_fingerprints(docs.where("doc_id = 9")).collect()
    assert [r.near_next for r in alone] == [1.0]


def test_edited_texts_without_blanks(spark):
    rng = random.Random(4)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(500)), "".join(rng.choice("あいうえおかきくけこ日本語") for _ in range(600)), "".join(rng.choice("abcdefghij") for _ in range(700))]
    rows = winnowing.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.near_edited > 0.3 and r.near_next < 0.05 for r in rows)


def test_neighbours_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "TASK_ROWS", 5)
    docs = spark.range(300).select((F.col("id") * 7 % 1000).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows = {r.doc_id: r for r in winnowing.edited_fingerprints(docs).collect()}
    ids = sorted(rows, reverse=True)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(ids) == 300
    for i, d in enumerate(ids):
        following, m = text[ids[(i + 1) % 300]], len(text[d]) // 3
        assert rows[d].edited_sha256 == hashlib.sha256((text[d][: len(text[d]) - m] + following[:m]).encode()).hexdigest()


@pytest.mark.parametrize("shares", [[1], [3, 5], [1, 1, 1, 7], [50, 30, 15, 4, 1], [333, 333, 334]])
def test_period_is_fair(shares):
    slots, total = mixing.period(shares), sum(shares)
    done = Counter()
    for t, (s, j) in enumerate(slots):
        assert j == done[s] and j * total // shares[s] <= t < -(-(j + 1) * total // shares[s])
        done[s] += 1
        for k, a in enumerate(shares):
            assert abs(done[k] - (t + 1) * a / total) < 1
    assert [done[k] for k in range(len(shares))] == shares


def test_mix_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shares = {f"src{i}": 1 + i for i in range(20)}
    rows = sorted(mixing.mix(docs, shares=shares, block=2).collect(), key=lambda r: r.mix.position)
    assert [r.mix.position for r in rows] == list(range(docs.count())) and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.mix.release <= r.mix.slot < r.mix.deadline for r in rows)
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r.mix.slot, []).append(r)
    assert all(len({(r.source, r.mix.block) for r in x}) == 1 for x in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    blocks = Counter()
    for slot in range(len(by_slot)):
        r = by_slot[slot][0]
        assert r.mix.block == blocks[r.source]
        blocks[r.source] += 1
        if r.mix.phase == 0:
            for s, a in shares.items():
                assert abs(blocks[s] - (slot + 1) * a / sum(shares.values())) < 1


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (None, None, 4), (2, None, 5), (3, "", 6)], "doc_id long, source string, slot int")
    got = mixing.mix(docs, block=2).collect()
    assert sorted(r.mix.position for r in got) == [0, 1, 2, 3, 4] and sorted(r.slot for r in got) == [3, 3, 4, 5, 6]
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.in_order(docs).columns == docs.columns and mixing.in_order(docs).count() == 5
    named = docs.withColumnRenamed("slot", "mix")
    assert mixing.in_order(named).columns == named.columns and sorted(r.mix for r in mixing.in_order(named).collect()) == [3, 3, 4, 5, 6]


def test_licenses(spark):
    texts = {
        "Copyright (c) 2020 Foo Bar. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n": ["All-Rights-Reserved"],
        '/* Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n */': ["Apache-2.0"],
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": ["GPL-3.0-or-later"],
        "Released under the MIT License.\nThis work is licensed under CC BY-NC 4.0.": ["MIT", "CC-BY-NC-4.0"],
        "SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"],
        "my licence to drive": [],
        "": [],
        None: [],
        "x" * 300_000: [],
    }
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, licenses int")
    got = {r.doc_id: list(r.licenses) for r in licenses.scan(docs).collect()}
    assert got == {i: w for i, w in enumerate(texts.values())}
    assert licenses.scan(docs.limit(0)).collect() == []


def test_every_known_sentence_has_a_trigger_and_is_normal():
    import re

    pattern = re.compile(licenses.TRIGGER)
    assert all(pattern.search(s) and s == " ".join(re.findall("[a-z0-9]+", s)) for s in licenses.SENTENCES)
    needed = {i for _, ids in licenses.RULES for i in ids}
    assert needed <= set(licenses.SENTENCES.values())


def brute_licences(text):
    """Identifiers and licences by plain loops over sentences and lists."""
    table = {re.sub(licenses._UNDER, "licensed under ", k): v for k, v in licenses.SENTENCES.items()}

    def ids(text):
        parts, now = [], ""
        for k, c in enumerate(text + "\n"):
            ends = c in ".!?;" or (c == ":" and now[-10:].lower() != "identifier")
            now += c
            if c == "\n" or (ends and text[k + 1 : k + 2].isspace()):
                parts.append(now)
                now = ""
        return [table[licenses.normal(x)] for x in parts if re.search(licenses.TRIGGER, x) and licenses.normal(x) in table]

    first = ids(re.sub(licenses._WRAP, " ", text))
    left = first + [i for i in ids(text) if i not in first]
    sequence, found = list(left), []
    for name, need in licenses.RULES:
        while True:
            at, places = 0, []
            for i in need:
                at = left.index(i, at) if i in left[at:] else -1
                if at < 0:
                    break
                places.append(at)
                at += 1
            if at < 0:
                break
            found.append(name)
            left = [x for k, x in enumerate(left) if k not in places]
    found += [licenses.TELLING[i] for i in left if i in licenses.TELLING]
    return sequence, list(dict.fromkeys(found))


def _license_texts():
    import os

    out, name = {}, None
    with open(os.path.join(os.path.dirname(licenses.__file__), "license_texts.txt")) as f:
        for line in f.read().splitlines():
            if line.startswith("== "):
                name = line[3:]
                out[name] = []
            elif name:
                out[name].append(line)
    return out


def test_whole_licence_texts_are_known_by_name(spark):
    import textwrap

    texts = {n: "\n".join(lines) for n, lines in _license_texts().items()}
    texts |= {f"wrapped {n}": "\n\n".join(textwrap.fill(x, 72) for x in lines) for n, lines in _license_texts().items()}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc_id: list(r.licenses) for r in licenses.scan(docs).collect()}
    for i, n in enumerate(texts):
        assert got[i][:1] == [n.removeprefix("wrapped ")], (n, got[i])


def test_licences_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").collect()]
    whole = ["\n".join(x) for x in _license_texts().values()]
    rng = random.Random(8)
    for k in range(120):
        lines = [rng.choice(rng.choice(whole).split("\n")) for _ in range(rng.randrange(1, 14))]
        rows.append((-1 - k, "\n\n".join(lines)))
    rows += [(-1000, "\n".join(whole)), (-1001, whole[4] * 3 + "\n" + whole[5]), (-1002, "Licensed under the Apache License, Version 2.0.\n" * 3000 + "you may not use this file except in compliance with the License.\n" * 3000)]
    got = {r.doc_id: (list(r.sentence_ids), list(r.licenses)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i] == brute_licences(text), i


def test_license_sql_against_brute_force():
    import textwrap

    import duckdb
    import pyarrow as pa

    from quarry.llm import queries

    rng, whole, rows = random.Random(3), ["\n".join(x) for x in _license_texts().values()], [None, "", "\n", "# a\n#  b\n\n", "Licensed under the\n * MIT License.\n"]
    for _ in range(150):
        lines = [rng.choice(rng.choice(whole).split("\n")) for _ in range(rng.randrange(1, 14))]
        rows.append(rng.choice(["\n", "\n\n", " ", "\r\n"]).join(textwrap.fill(x, 72) if rng.random() < 0.5 else x for x in lines))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(rows))), "text": rows}))
    for doc_id, ids, names in con.execute(queries.SQL["op9_license_scan"]).fetchall():
        want = brute_licences(rows[doc_id] or "")
        assert (ids, names) == (" ".join(want[0]), " AND ".join(want[1]))


def test_the_tables_agree_with_the_columns(spark):
    lines = sorted({x for own in _license_texts().values() for x in own} | set(licenses.SENTENCES))
    rows = spark.createDataFrame([(x,) for x in lines], "s string").select("s", licenses._normal(F.col("s")).alias("n")).collect()
    assert all(r.n == licenses.normal(r.s) for r in rows) and len(licenses.SENTENCES) > 500
    assert len({n for n, _ in licenses.RULES}) > 40


def test_license_lines_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    got = {r.doc_id: set(r.licenses) - {"All-Rights-Reserved"} for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == {v for k, v in lines.items() if k in r.text}


def test_mix_of_several_hundred_sources(spark):
    """More phases times slots than SCHEDULE_ROWS; every source is in its windows, and within a block of its share in each prefix."""
    n = 300
    docs = spark.range(n * 90).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % n).alias("source")).where("doc_id % 7 > 0 or doc_id % 300 < 150")
    rows = sorted(mixing.mix(docs, block=1).collect(), key=lambda r: r.mix.position)
    assert [r.mix.position for r in rows] == list(range(docs.count())) and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.mix.release <= r.mix.slot < r.mix.deadline for r in rows)
    assert max(r.mix.phase for r in rows) == n - 1
    done = Counter()
    first = [r for r in rows if r.mix.phase == 0]
    weight = {r.source: r.mix.target_weight for r in first}
    for t, r in enumerate(first):
        done[r.source] += 1
        assert abs(done[r.source] - (t + 1) * weight[r.source]) < 1
        if t % 500 == 0:
            assert all(abs(done[s] - (t + 1) * w) < 1 for s, w in weight.items())


def brute_mix(counts, shares, block):
    """{source: slots of its blocks in order}: slot by slot, the released block with the earliest deadline; weights start anew when a source runs out."""
    left = {s: -(-n // block) for s, n in counts.items()}
    slots, t = {s: [] for s in counts}, 0
    while any(left.values()):
        active = sorted((s for s in counts if left[s]), key=lambda s: (s is None, s or ""))
        weight = {s: Fraction(shares[s], sum(shares[x] for x in active)) for s in active}
        done, begin = dict.fromkeys(active, 0), t
        while all(left[s] for s in active):
            ready = [s for s in active if int(done[s] / weight[s]) <= t - begin]
            s = min(ready, key=lambda s: (math.ceil((done[s] + 1) / weight[s]), active.index(s)))
            slots[s].append(t)
            done[s] += 1
            left[s] -= 1
            t += 1
    return slots


@pytest.mark.parametrize("shares", [None, {"src1": 5, "src2": 90}])
def test_mix_against_brute_force(spark, sf, shares):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    rows = mixing.mix(docs, shares=shares, block=3).collect()
    counts = Counter(r.source for r in rows)
    names = sorted(counts)
    own = dict(zip(names, mixing.corpus_shares([counts[s] for s in names], 0.5))) if shares is None else {s: shares.get(s, 1) for s in names}
    want = brute_mix(counts, own, 3)
    got = {s: {} for s in names}
    for r in rows:
        got[r.source][r.mix.block] = r.mix.slot
    assert {s: [got[s][b] for b in sorted(got[s])] for s in names} == want
    assert sorted(r.mix.position for r in rows) == list(range(len(rows)))


def test_mix_of_two_thousand_sources(spark):
    """Every source in its windows in each phase, positions without gaps, nothing lost."""
    n = 2000
    docs = spark.range(n * 12).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % n).alias("source")).where(f"doc_id < {n * 4} or doc_id % {n} < 500")
    rows = mixing.mix(docs, block=1).collect()
    assert sorted(r.mix.position for r in rows) == list(range(docs.count())) and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.mix.release <= r.mix.slot < r.mix.deadline for r in rows)
    seen = Counter((r.source, r.mix.block) for r in rows)
    assert max(seen.values()) == 1 and len({r.source for r in rows}) == n


def test_schedule_longer_than_a_literal():
    """300 near-equal sources with many blocks: over 200,000 slots, each source's blocks all placed."""
    blocks = [20_000 + 90 * k for k in range(300)]
    found = list(mixing.phases(mixing.corpus_shares(blocks, 0.5), blocks))
    assert sum(f["length"] for f in found) == sum(blocks) and len({f["ended"] for f in found}) == 300
    assert sum(len(at) for f in found for at in f["at"].values()) > mixing.SCHEDULE_ROWS


def test_plain_license_statements(spark):
    gnu = "This library is free software{} you can redistribute it and/or\nmodify it under the terms of the GNU {}General Public License\nas published by the Free Software Foundation{} either\nversion {} of the License, or (at your option) any later version."
    texts = {
        "Foo is licensed under the MIT License.": ["MIT"],
        "This dataset is licensed under the MIT License.": ["MIT"],
        "Foo-bar 2 is not licensed under the MIT License.": [],
        "Released under the Apache License, Version 2.0": ["Apache-2.0"],
        "Distributed under the BSD 3-Clause License": ["BSD-3-Clause"],
        "The Foo tools are released under the terms of the GNU Lesser General Public License, version 2.1 or later.": ["LGPL-2.1-or-later"],
        gnu.format(";", "Lesser ", ";", "2.1"): ["LGPL-2.1-or-later"],
        gnu.format(":", "Lesser ", ",", "3"): ["LGPL-3.0-or-later"],
        gnu.format(":", "Affero ", ", ", "3"): ["AGPL-3.0-or-later"],
        gnu.format(";", "", ";", "2"): ["GPL-2.0-or-later"],
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": ["ISC"],
        "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)": ["BSL-1.0"],
        "Foo is available under the ISC licence.": ["ISC"],
        "SPDX-License-Identifier: LGPL-2.1-only": ["LGPL-2.1"],
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: list(r.licenses) for r in licenses.scan(docs).collect()}
    assert got == {i: w for i, w in enumerate(texts.values())}
