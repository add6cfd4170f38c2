import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quarry.llm import chunk_tokens, packing, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a<|endoftext|>b C<|STARTOFTEXT|>d",
    "x\x1cy\x85z Q r",
    "J̌ ẖ",
    "Σας ΟΔΟΣ İstanbul",
    "it's don't I'LL we've dogs' 12 ²³ ½",
    "",
    None,
    "  ",
    " \n\t ",
    "日本語 テスト",
    "ﬁ ǅ ß ẞ",
    "é É, a.b, foo), ...",
    "<|startoftext|>",
    "x" * 5000 + " é" * 10,
    "ª º µ,",
    "Hello, WORLD!!! ok.",
    "word***, <b>bold</b> user@mail.org 3.14",
]


def want(text):
    return chunk_tokens.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def check(texts):
    ids, ends = chunk_tokens.encode_texts(PATH, pa.array(texts, pa.string()), 0)
    counts = chunk_tokens.count_tokens(PATH, pa.array(texts, pa.string()))
    begin = 0
    for text, end, n in zip(texts, ends, counts):
        assert list(ids[begin:end]) == [*want(text), 0], text
        assert n == len(want(text))
        begin = end


def test_odd_texts():
    check(ODD)


def test_every_character_up_to_0300_and_all_spaces():
    codes = [*range(0x300), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    check([f"Ab{chr(c)}cD, {chr(c)} e{chr(c)}" for c in codes if unicodedata.category(chr(c)) != "Cs"])


def test_random_words_of_all_lengths():
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzéèñüßABC"
    check(["".join(rng.choice(letters) for _ in range(n)) + rng.choice(["", ".", ",", "!?", "'"]) for n in range(1, 60) for _ in range(6)])


def test_whole_documents(spark, sf):
    check([r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()])


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_and_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, rng.integers(1, 80))
    bins, offsets, fill = packing.best_fit_decreasing(sizes, 100)
    assert (np.bincount(bins, sizes) == fill).all() and fill.max() <= 100
    for b in range(len(fill)):
        own = np.argsort(offsets[bins == b])
        o, s = offsets[bins == b][own], sizes[bins == b][own]
        assert (o == np.cumsum(s) - s).all()
    bound = packing.lower_bound(sizes, 100)
    assert -(-sizes.sum() // 100) <= bound <= len(fill)


def test_bound_sees_large_items():
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3
    assert packing.lower_bound(np.zeros(0, np.int64), 100) == 0


def brute(texts, capacity):
    out = {}
    for doc, text in texts:
        ids = [*want(text), 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            out[doc, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    return out


def check_packing(rows, texts, capacity):
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == brute(texts, capacity)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0, *(n for _, n in places)])[:-1]) and sum(n for _, n in places) <= capacity
    return len(held)


def test_packing_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(40)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    n = check_packing(packing.pack_documents(docs, PATH).collect(), texts, 2048)
    total = sum(n for _, n, _ in brute(texts, 2048).values())
    assert n <= -(-total // 2048) + 2


def test_large_pools_are_dealt_to_several_tasks(spark, sf, monkeypatch):
    """No task takes many more than REPACK_ROWS documents, and the packing is as tight as in one task."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(40)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(packing, "REPACK_ROWS", 30)
    n = check_packing(packing.pack_documents(docs, PATH, capacity=1000).collect(), texts, 1000)
    total = sum(n for _, n, _ in brute(texts, 1000).values())
    assert n <= -(-total // 1000) * 1.03 + 2
    over_half = spark.createDataFrame([(i, "the " * (600 + i)) for i in range(90)], "doc_id long, text string").repartition(20)
    check_packing(packing.pack_documents(over_half, PATH, capacity=1000).collect(), [(r.doc_id, r.text) for r in over_half.collect()], 1000)


def test_packing_edges(spark):
    texts = [(1, None), (2, ""), (3, "a b"), (None, "c"), (5, "word " * 50)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, offset int")
    check_packing(packing.pack_documents(docs, PATH, capacity=16).collect(), texts, 16)
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []
    twice = docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3"))
    assert packing.pack_documents(twice, PATH).count() == 2


def test_token_counts_and_cache(spark, tmp_path):
    texts = [*ODD, "same text", "same text", " same\n text "]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, content string")
    cache = str(tmp_path / "cache")
    first = token_counts.token_counts(docs, PATH, cache_dir=cache, limit=3).collect()
    assert {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in first} == {i: (len(want(t)), len((t or "").encode()), len(want(t)) > 3) for i, t in enumerate(texts)}
    assert not any(r.cached for r in first)
    stored = spark.read.option("recursiveFileLookup", True).parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({re.sub("[ \t\n\x0b\f\r]+", " ", t or "").strip(" ") for t in texts})
    more = docs.unionByName(spark.createDataFrame([(99, "new words", "x")], docs.schema))
    second = token_counts.token_counts(more, PATH, cache_dir=cache).collect()
    assert [r.doc_id for r in second if not r.cached] == [99] and len(second) == len(texts) + 1
    assert token_counts.token_counts(docs.limit(0), PATH, cache_dir=cache).collect() == []
    n = stored.count()
    batches = len(list((tmp_path / "cache").iterdir()))
    third = token_counts.token_counts(more, PATH, cache_dir=cache).collect()
    assert all(r.cached for r in third) and len(list((tmp_path / "cache").iterdir())) == batches == 2
    assert token_counts.compact(spark, cache) == n + 1 and len(list((tmp_path / "cache").iterdir())) == 1
    assert sorted(token_counts.token_counts(more, PATH, cache_dir=cache).collect()) == sorted(third)
    assert token_counts.compact(spark, str(tmp_path / "none")) == 0
