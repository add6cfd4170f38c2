import os
import subprocess
import sys
from types import SimpleNamespace

import corpus_pipeline
import oracle
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quarry.llm import chunk_tokens, language_id, queries, simhash_dedup


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    oracle.compare(spark, oracle.connect(sf), sf, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    model = language_id.fit(docs)
    known = {r.doc_id for r in language_id.predict(docs, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
    best = {}
    for r in rows:
        if r.doc_id in known:
            best[r.text] = max(best.get(r.text, -1), r.doc_id)
    left = {i: simhash_dedup.fingerprint(t.encode()) for t, i in best.items()}
    root = {i: i for i in left}
    for _ in range(len(left)):
        before = dict(root)
        for a in left:
            for b in left:
                if (left[a] ^ left[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    want = {i for i in left if root[i] == i}
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in found} == want
    from quarry.llm import chunk_tokens

    tok = chunk_tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in rows}
    total = sum(len(tok.encode(text[i], add_special_tokens=False).ids) + 1 for i in want)
    assert sum(r.length for r in found) == total and len({r.sequence_id for r in found}) <= -(-total // 2048) + 3


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0


CLASHING = ("mix", "mix_part", "mix_row", "gone", "whole", "hash", "twice", "print", "row", "id", "key", "shard", "number", "made", "position", "open", "length")


def test_stages_with_nulls_ties_and_clashing_names(spark):
    """Each stage: nulls in any column, empty and long texts, repeated rows, extra columns of any name; what is kept keeps all its columns."""
    from pyspark.sql import functions as F

    from quarry.runtime import stored

    en, de = "the cat and the dog are here", "der hund und die katze sind hier"
    rows = [(1, en, "en", "a", 1), (2, de, "de", None, None), (None, en + " too", "en", "a", 3), (4, None, "en", "b", 4), (5, "", None, None, 5), (6, "12 !!", "en", "a", 6), (7, en, "en", "a", 7), (7, en, "en", "a", 7), (8, (en + " ") * 9000, "en", "b", 8), (None, None, None, None, None), (9, "katze hund " * 30, "de", "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = stored(docs.withColumns({c: F.lit(c) for c in CLASHING}), "clashing")
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, ""), name)
        assert docs.columns == before.columns and docs.exceptAll(before).isEmpty()
        assert all(docs.select(*CLASHING).distinct().first()[c] == c for c in CLASHING)
        kept = sorted(str(r.doc_id) for r in docs.collect())
        if name == "language":
            assert kept == ["1", "2", "7", "7", "8", "9", "None"]
        elif name == "exact_dedup":
            assert kept == ["2", "7", "8", "9", "None"]
    packed = corpus_pipeline.packed_sequences(spark, docs, "").collect()
    assert sorted({str(r.doc_id) for r in packed}) == kept and all(r.offset + r.length <= 2048 for r in packed)
    alone = stored(before.limit(0), "none")
    assert corpus_pipeline.packed_sequences(spark, alone, "").collect() == []


def test_sequences_follow_the_mix(spark, monkeypatch):
    """Sources of unlike lengths: each prefix of the sequences has every source's share to within 100 of 6,000 documents."""
    from pyspark.sql import functions as F

    from quarry.llm import packing
    from quarry.runtime import stored

    monkeypatch.setattr(packing, "STRETCH", 64)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("word "), (F.lit(20) + (F.col("id") % 3) * 150 + F.col("id") % 17).cast("int")).alias("text"))
    mixed = stored(corpus_pipeline.mixed_sources(spark, docs, ""), "mixed")
    rows = corpus_pipeline.packed_sequences(spark, mixed, "").collect()
    assert sorted(r.doc_id for r in rows) == list(range(6000))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(x, x[1:])) and sum(x[-1]) <= 2048
    done = [0, 0, 0]
    worst = 0
    for t, r in enumerate(sorted(rows, key=lambda r: (r.sequence_id, r.offset))):
        done[r.doc_id % 3] += 1
        worst = max(worst, *(abs(n - (t + 1) / 3) for n in done))
    total = sum(r.length for r in rows)
    assert worst <= 100 and len(places) <= -(-total // 2048) * 1.02 + 4


_PASSES = '''
import re, sys, threading, time
import pyarrow as pa, pyarrow.parquet as pq, public_tokenizers
from quarry.llm import packing

def held():
    return int(re.search(r"Anonymous: +(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

def watch():
    while going:
        most[0] = max(most[0], held())
        time.sleep(0.005)

texts = pq.read_table(sys.argv[1], columns=["text"])["text"].drop_null().to_pylist()
size = sum(len(x.encode()) for x in texts)
rows = texts * -(-(16 << 20) // size)
batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(rows))), "text": pa.array(rows, pa.string())})
run = lambda b: sum(len(x[1]) for x in packing._pieces(public_tokenizers.path("word_bpe_49k.json"), 2048, 0, [b]))
run(batch.slice(0, 50))  # loads what stays
going, most, before = True, [0], held()
watcher = threading.Thread(target=watch)
watcher.start()
assert run(batch) >= len(rows)
going = False
watcher.join()
print(most[0] - before)
'''


def test_packing_holds_little_besides_its_batch(sf):
    """16 MB of texts in one batch: the Python worker takes less than 100 MB more for them (two stand beside an executor's heap)."""
    home = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    env = os.environ | {"PYTHONPATH": os.pathsep.join(x for x in (home, os.environ.get("PYTHONPATH", "")) if x), "OMP_NUM_THREADS": "1"}
    done = subprocess.run([sys.executable, "-c", _PASSES, f"{sf}/documents.parquet"], capture_output=True, text=True, env=env, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 100


def test_language_scores_four_megabytes_at_a_time(monkeypatch):
    """No pass is larger, and each text's answer is that of the text alone."""
    sizes, split = [], chunk_tokens.split
    monkeypatch.setattr(chunk_tokens, "split", lambda texts: sizes.append(pc.sum(pc.binary_length(texts)).as_py()) or split(texts))
    model = language_id.LanguageModel.of({"en": {"the": 2, "and": 1}, "de": {"der": 2, "und": 1}})
    texts = [f"{'the and' if i % 3 else 'der und'} w{i} " * 4000 for i in range(200)]
    labels, shares = model.score(pa.array(texts))
    assert sum(sizes) > 7 << 20 and max(sizes) <= 4 << 20
    for i in (0, 1, 99, 199):
        (label,), (share,) = model.score(pa.array(texts[i : i + 1]))
        assert (labels[i], shares[i]) == (label, share)


def test_passes_do_not_change_the_sequences(spark, sf, monkeypatch):
    """Stretches have as many pieces whatever the size of a pass; so the places are the same."""
    from quarry.llm import packing

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toArrow().combine_chunks().to_batches()
    found = []
    for size in (1 << 30, 20_000):
        monkeypatch.setattr(packing, "PASS_BYTES", size)
        monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
        pack = packing._stretches(public_tokenizers.path("word_bpe_49k.json"), 2048, 0, 16)
        found.append([r for b in pack(rows) for r in b.to_pylist()])
    assert len(rows) == 1 and len(found[0]) >= rows[0].num_rows and found[0] == found[1]


def test_pipeline_reads_a_store_that_only_spark_reads(spark, sf):
    """The same rows by viewfs://, which Python cannot open, as by a local path."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.quarry.link./in", f"file://{sf}")
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    near, far = (sorted(map(key, corpus_pipeline.run(spark, at).collect())) for at in (sf, "viewfs://quarry/in"))
    assert near and near == far
