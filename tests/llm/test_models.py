import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quarry.llm import language_id, queries, quality, toxicity, words


def auc(y, x):
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x))
    rank[order] = np.arange(1, len(x) + 1)
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def larger(sf):
    return sf.replace("0.001", "0.01")


def test_language_held_out(spark, larger):
    found = queries.op3_language_id(spark, larger).join(spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == 1000 and found.score.between(0, 1).all()
    assert (found.lang == found.lang_pred)[found.held_out].mean() > 0.97


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    docs = spark.createDataFrame([(1, "the dogs", "a"), (2, None, "b"), (3, "123 !!", "c"), (4, "chien", "d"), (4, "chien", "d"), (5, "the " * 60_000, "e"), (6, "", "f")], "doc_id long, text string, score string")
    got = sorted((r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).collect())
    assert got == [(1, "en"), (2, "und"), (3, "und"), (4, "fr"), (4, "fr"), (5, "en"), (6, "und")]
    kept = language_id.keep_known(docs, model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 4, 5] and kept.columns == docs.columns
    assert language_id.predict(docs.limit(0), model).collect() == []
    empty = language_id.fit(train.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, empty).collect()} == {("und", 0.0)}


def test_unknown_words_back_off():
    model = language_id.LanguageModel.of({"de": {"strasse": 5, "haus": 3}, "es": {"calle": 4, "casa": 2}})
    assert model.word("strassen")[0] > model.word("strassen")[1] and model.word("casas")[1] > model.word("casas")[0]
    assert (model.word("日本") == 0).all()


def brute_language(counts, text):
    """(language, probability) by plain dictionaries."""
    letters = regex.compile(r"\p{L}+")
    langs = sorted(counts)
    vocabulary = sorted({w for c in counts.values() for w in c})
    log = lambda n, total, many: math.log((n + 0.5) / (total + 0.5 * many + 1e-9))
    totals = {x: sum(counts[x].values()) for x in langs}
    grams = [{x: Counter() for x in langs} for _ in range(5)]
    cut = lambda w, k: [w[i : i + 1] for i in range(len(w))] if k == 1 else [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)]
    for x in langs:
        for w, n in counts[x].items():
            for k in range(1, 6):
                for g in cut(w, k):
                    grams[k - 1][x][g] += 1 + math.log(n)
    known = [set().union(*(level[x] for x in langs)) for level in grams]

    def word(w):
        if w in vocabulary:
            raw = [log(counts[x].get(w, 0), totals[x], len(vocabulary)) for x in langs]
        else:
            raw = [0.0] * len(langs)
            for k in range(5, 0, -1):
                hits = [g for g in cut(w, k) if g in known[k - 1]]
                if hits:
                    raw = [sum(log(grams[k - 1][x][g], sum(grams[k - 1][x].values()), len(known[k - 1])) for g in hits) / len(hits) for x in langs]
                    break
        return [v - max(raw) for v in raw]

    found = [word(w) for w in letters.findall(text.lower())]
    if not found:
        return "und", 0.0
    total = [sum(v) * min(len(found), language_id.EVIDENCE) / len(found) for v in zip(*found)]
    odds = [math.exp(v - max(total)) for v in total]
    return langs[odds.index(max(odds))], max(odds) / sum(odds)


def test_language_against_brute_force():
    counts = {"fr": {"homme": 9, "le": 40, "l": 20, "chat": 3, "été": 2}, "de": {"der": 30, "mann": 4, "straße": 2, "l": 1}, "es": {"el": 33, "hombre": 5, "gato": 2}}
    texts = ["l'homme", "Der Mann-der", "hombres gatos", "chats 12 ÉTÉ!!", "qqq", "12", "", "el,el;le", "straßen der katze", "日本 le", " ".join(["le el"] * 200), "x" * 3000]
    model = language_id.LanguageModel.of(counts)
    labels, shares = model.score(pa.array(texts))
    for text, label, share in zip(texts, labels, shares):
        want = brute_language(counts, text)
        assert abs(share - want[1]) < 1e-4 and (label == want[0] or abs(share - 1 / 3) < 1e-6), text


def test_one_splitter():
    """Words inside marks are those that training counted."""
    model = language_id.LanguageModel.of({"fr": {"homme": 5, "l": 9}, "es": {"homme": 1, "l": 1, "lhomme": 50}})
    assert model.score(pa.array(["l'homme"]))[0] == ["fr"] and language_id.split("L’Homme-été 3x") == ["l", "homme", "été", "x"]


def test_language_ties(spark):
    train = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "same words"), (1, "same words")], "doc_id long, text string")
    assert {(r.lang_pred, round(r.score, 6)) for r in language_id.predict(docs, language_id.fit(train)).collect()} == {("a", 0.5)}


def test_ordinal_grades():
    rng = np.random.default_rng(0)
    kinds = ["bad", "poor", "fine", "good"]
    y = rng.integers(0, 4, 600)
    texts = [" ".join(rng.choice([*(["filler", "text", "more"]), *([kinds[k]] * 3)], 30)) for k in y]
    model = quality.OrdinalModel(np.arange(4)).fit(pa.array(texts[:400]), y[:400].astype(float))
    assert (np.diff(model.thresholds) > 0).all()
    expected, tail = model.score(pa.array(texts[400:]), 2)
    assert np.corrcoef(expected, y[400:])[0, 1] > 0.9 and ((tail > 0.5) == (y[400:] >= 2)).mean() > 0.9


def test_quality_held_out(spark, larger):
    found = queries.op5_quality_classifier(spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").toPandas()
    held = found[found.held_out]
    assert auc(held.quality.to_numpy(), held.tail_probability.to_numpy()) > 0.95
    assert found.expected_grade.between(0, 1).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", 1), (2, None, 2), (3, "", 3), (3, "", 3)], "doc_id long, text string, selected int")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.expected_grade for r in quality.predict(docs, none).collect()} == {0.0}
    one = quality.fit(docs, spark.createDataFrame([(1, 2), (2, None)], "doc_id long, quality int"))
    assert {(r.expected_grade, r.tail_probability) for r in quality.predict(docs, one).collect()} == {(2.0, 1.0)}
    assert quality.predict(docs.limit(0), one).collect() == []


def test_toxicity_held_out(spark):
    """Insults share a stem within a language; some held-out words were never seen."""
    rng = np.random.default_rng(1)
    clean = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows = []
    for i in range(500):
        text = list(rng.choice(clean, 40))
        toxic = int(rng.random() < 0.25)
        if toxic:
            text[rng.integers(0, 40)] = "zorgl" + "".join(rng.choice(list("mnop"), 3))
        rows.append((i, " ".join(text), toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.drop("toxic"), table.where("doc_id < 350").select("doc_id", "toxic"))
    got = toxicity.predict(table.drop("toxic"), model).join(table, "doc_id").where("doc_id >= 350").toPandas()
    assert auc(got.toxic.to_numpy(), got.score.to_numpy()) > 0.97 and (got.predicted == got.toxic).mean() > 0.93
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_scores_all_words_in_blocks(monkeypatch):
    texts = pa.array(["aa bb cc dd", "cc aa", "", "bb bb bb bb bb bb bb"] * 5)
    model = toxicity.ToxicityModel().fit(texts, np.array([1, 0, 0, 1] * 5))
    whole = model._all(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    assert np.allclose(whole, model._all(texts), atol=1e-5)


def brute_toxicity(model, text):
    """The raw answer, word by word in plain Python."""
    mix, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def poly(s, h):
        for c in s:
            h = ((h ^ (h >> 29)) * mix + ord(c)) & mask
        return h * mix & mask

    embedded = []
    for chunk in [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w] or [""]:  # a text without words has an empty one
        w = ("".join(c for c in chunk if c.isalnum()) or chunk).lower()
        keys = [zlib.crc32(w.encode()) << 32]
        keys += [poly(w[:n], n) for n in toxicity.PREFIXES if len(w) > n]
        keys += [poly(f"^{w}$"[i : i + toxicity.PART], 0) ^ (1 << 63) for i in range(len(w) + 3 - toxicity.PART)]
        embedded.append(sum(model.rows[(k >> 32) % toxicity.BUCKETS].astype(float) for k in keys) / math.sqrt(len(keys)))
    out = model.base
    for k, f in enumerate(model.filters):
        for j in range(toxicity.FILTERS):
            answers = [sum(embedded[i + o] @ f[o][:, j] for o in range(len(f))) for i in range(len(embedded) - len(f) + 1)]
            # a text shorter than the filter is filled up with words of nothing
            answers += [sum(embedded[i + o] @ f[o][:, j] for o in range(len(embedded) - i)) for i in range(max(len(embedded) - len(f) + 1, 0), len(embedded))]
            n = k * toxicity.FILTERS + j
            out += model.out[n] * max(max(answers, default=0.0) + model.bias[n], 0.0)
    return out


def test_toxicity_against_brute_force():
    texts = ["you zorgling trash", "Fine words, here; and there", "", "one", "!! ?? zorgl", "été strasse zorglonger", " ".join(["calm words"] * 40 + ["zorglist"]), "x" * 5000]
    model = toxicity.ToxicityModel().fit(pa.array(texts * 3), np.array([1, 0, 0, 0, 1, 1, 1, 0] * 3))
    assert np.allclose(model._all(pa.array(texts)), [brute_toxicity(model, t) for t in texts], atol=1e-3)


def test_toxicity_of_documents(spark, larger):
    """Held-out labels of a small table: two toxic texts of German are all there is to learn from."""
    found = queries.op6_toxicity(spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(found.toxic.to_numpy(), found.score.to_numpy()) > 0.9
    assert found.predicted[found.toxic == 0].mean() < 0.05 and found.predicted[found.toxic == 1].mean() > 0.7


def test_training_adds_to_the_log_odds():
    """Two words are toxic only side by side, so that word counts tell nothing."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        text = list(rng.choice([f"w{j}" for j in range(40)], 12))
        toxic = int(i % 2)
        at = int(rng.integers(0, 5))
        text[at], text[at + 1 if toxic else at + 6] = "alpha", "omega"
        rows.append((" ".join(text), toxic))
    texts, y = pa.array([t for t, _ in rows]), np.array([k for _, k in rows])
    score = lambda epochs: auc(y[400:], toxicity.ToxicityModel().fit(texts.slice(0, 400), y[:400], epochs=epochs)._all(texts.slice(400)))
    assert score(0) < 0.75 and score(30) > 0.95


def test_toxicity_ties_and_long_texts(spark):
    assert toxicity.best_threshold(np.array([1.0, 1.0, 1.0, 0.0]), np.array([1, 0, 1, 0])) == 0.5
    docs = spark.createDataFrame([(i, "calm words here " * 3 + ("zorgl" if i % 2 else "quiet")) for i in range(20)] + [(50, "calm words " * 60_000 + "zorgl"), (51, "calm words " * 60_000), (52, "same"), (52, "same")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"))
    got = {}
    for r in toxicity.predict(docs, model).collect():
        assert got.setdefault(r.doc_id, r) == r
    assert got[50].predicted == 1 and got[51].predicted == 0
    assert toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"), train_bytes=10).threshold == 1e9


def brute_quality(model, text, grade):
    words_ = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w] or [""]
    n = max(len(words_), 1)
    mean = lambda f: sum(map(f, words_)) / n
    x = [mean(lambda w: not any(c.isalnum() for c in w)), mean(lambda w: w[-1:] in ".!?"), mean(lambda w: any(c.isdigit() for c in w)), mean(lambda w: w[:1].isupper()), mean(lambda w: min(len(w), 40) / 10)]
    x += [sum(a == b for a, b in zip(words_, words_[1:])) / n, len(set(words_)) / n, math.log1p(len(words_)) / 10, float(not words_)]
    latent = sum(model.hashed[zlib.crc32(w.lower().encode()) % quality.BUCKETS] for w in words_) / math.sqrt(n) + ((np.array(x) - model.mean) / model.spread) @ model.shape
    below = [0.0, *(1 / (1 + math.exp(latent - t)) for t in model.thresholds), 1.0]
    p = [b - a for a, b in zip(below, below[1:])]
    return sum(q * g for q, g in zip(p, model.grades)), sum(q for q, g in zip(p, model.grades) if g >= grade)


def test_quality_against_brute_force():
    texts = ["Good words here. All fine!", "bad bad bad bad", "", "?? !! ..", "One 2 three", "x" * 9000, "tie tie", "tie tie"]
    model = quality.OrdinalModel(np.array([0.0, 1.0, 3.0])).fit(pa.array(texts * 4), np.array([3, 0, 0, 0, 1, 1, 1, 1] * 4, float))
    expected, tail = model.score(pa.array(texts), 1)
    for t, e, p in zip(texts, expected, tail):
        assert np.allclose((e, p), brute_quality(model, t, 1), atol=1e-4)
    assert expected[-1] == expected[-2]


def test_quality_long_texts_and_bytes(spark):
    docs = spark.createDataFrame([(1, "good words. " * 50_000), (2, "bad bad " * 50_000), (3, "good words."), (4, "bad bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.selected for r in quality.predict(docs, quality.fit(docs, labels)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    short = quality.fit(docs, labels, train_bytes=100)
    assert len(short.grades) <= 2 and len(quality.predict(docs, short).collect()) == 4


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 2), (3, "", 3), (3, "", 3)], "doc_id long, text string, score int")
    for labels in ([], [(1, 0), (2, 0)], [(1, 1), (2, 0), (3, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.predict(docs, model).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.predict(docs.limit(0), model).collect() == []


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    one = words.sample(rows, 500, "k")
    assert 350 < one.count() < 650 and one.exceptAll(words.sample(rows, 500, "k")).isEmpty()
    assert words.sample(rows, 9000, "k").count() == 5000


def test_remainder(spark):
    import zlib

    got = spark.range(50).select("id", words.remainder("id", 3).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 3 for r in got)
    assert spark.createDataFrame([(None,)], "id long").select(F.coalesce(words.remainder("id", 3), F.lit(-1))).first()[0] == 0


def test_language_vocabulary_and_grams_are_whole(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [a + b + c + d for a in letters for b in letters for c in letters for d in "aei"][:30_000]
    train = spark.createDataFrame([(i, " ".join(names[i * 100 : i * 100 + 100]), "en") for i in range(300)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert len(model.keys) == len(names) and (model.table(names) == 0).all() and set(model.keys.tolist()) == set(model._word_keys(names).tolist())
    rare = language_id.LanguageModel.of({"de": {"strasse": 5}})
    assert len(rare.grams[3][0]) == 6 and len(rare.grams[4][0]) == 5


def test_toxicity_trains_eight_epochs_with_the_whole_language_model(monkeypatch, spark, sf):
    texts, toxic = pa.array(["aa bb cc dd", "cc aa", "bb", "bb bb zz"] * 5), np.array([1, 0, 0, 1] * 5)
    assert np.array_equal(toxicity.ToxicityModel().fit(texts, toxic).out, toxicity.ToxicityModel().fit(texts, toxic, epochs=8).out)
    asked = []
    fit = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda docs, **options: asked.append(options) or fit(docs, **options))
    queries.op6_toxicity(spark, sf)
    assert asked == [{}]


def test_toxicity_learns_from_all_labels(monkeypatch, spark):
    """Every labelled text sets the thresholds and every word of them has learned, in several shards too."""
    rows = [(i, f"calm{i} words {'zorgl' if i % 60 == 0 else 'here'} again{i % 7}", int(i % 60 == 0)) for i in range(2700)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen, best = [], toxicity.best_threshold
    monkeypatch.setattr(toxicity, "best_threshold", lambda z, toxic, *more: seen.append((len(z), int((toxic == 1).sum()))) or best(z, toxic, *more))
    for size in (1 << 20, 20_000):
        monkeypatch.setattr(toxicity, "SHARD_BYTES", size, raising=False)
        model = toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"))
        assert seen.pop() == (2700, 45) and not seen
        keys, starts = toxicity._flat([f"calm{i}" for i in range(2700)])
        assert model.rows[keys[starts[:-1]]].any(1).all()
        got = toxicity.predict(table.drop("toxic"), model).join(table, "doc_id").where("predicted = toxic").count()
        assert got == 2700


def test_toxicity_shards_add_up():
    texts, toxic = [f"aa b{i % 5} cc{i}" for i in range(12)] + ["", ""], np.array([1, 0] * 7)
    fold = np.arange(14) % 4

    def shard(own):
        names, index, bounds = toxicity.chunk_tokens.split(pa.array([texts[i] for i in own]))
        return toxicity.Shard.unpacked(toxicity.Shard.of(names.to_pylist(), index, bounds, toxic[own], fold[own]).packed())

    whole, parts = shard(np.arange(14)), [shard(np.arange(14)[k::3]) for k in range(3)]
    total = {}
    for x in parts:
        toxicity._add(total, x.counts(4))
    assert all(np.array_equal(total[name], x) for name, x in whole.counts(4).items())
    # models side by side are what each is alone
    models = [toxicity.ToxicityModel() for _ in range(5)]
    both = toxicity.Training(models, total, [None, 0, 1, 2, 3], 7)
    alone = toxicity.Training(models[:1], total, [2], 7)
    for x in (both, alone):
        for k in range(3):
            x.epoch(whole, np.random.default_rng(k))
    assert np.allclose(both.rows[:, 3], alone.rows[:, 0], atol=1e-4) and np.allclose(both.params[-1][3], alone.params[-1][0], atol=1e-4)
    # the average of one result is that result
    before = toxicity.Training(models, total, [None, 0, 1, 2, 3], 7)
    after = before.copy()
    after.epoch(whole, np.random.default_rng(0))
    before.averaged(after.copy().changed(before, 14))
    assert np.allclose(before.rows, after.rows, atol=1e-6) and np.allclose(before.small(), after.small())


def test_toxicity_sums_reach_the_driver_in_small_pieces(monkeypatch, spark):
    """The driver gets a few MB of a task's sums at a time, however large they are, and the broadcast is gone by then."""
    wide, kept = np.random.default_rng(1).random((1 << 16, 40), np.float32), []
    names, index, bounds = toxicity.chunk_tokens.split(pa.array(["aa bb"]))
    one = toxicity.Shard.of(names.to_pylist(), index, bounds, np.array([1]), np.array([0])).packed()
    shards = spark.createDataFrame([(k, one, ["en"]) for k in range(3)], "shard int, data binary, langs array<string>").coalesce(2)
    monkeypatch.setattr(toxicity, "forget", lambda *tables: kept.extend(tables))
    used = spark.sparkContext.broadcast(wide)
    gone, destroy = [], used.destroy
    monkeypatch.setattr(used, "destroy", lambda: gone.append(True) or destroy())
    total = toxicity._summed(shards, lambda number, shard, total, kept: toxicity._add(total, {"wide": wide + number, "few": np.eye(3)}), used)
    assert np.allclose(total["wide"], 3 * wide + 3, atol=1e-5) and np.array_equal(total["few"], 3 * np.eye(3)) and gone
    sums = kept[0]
    assert sums.selectExpr("max(length(data))").first()[0] <= 64 << 10
    with toxicity._held(spark, "spark.sql.files.maxPartitionBytes", str(toxicity.SENT_BYTES)):
        parts = sums.selectExpr("spark_partition_id() as part", "length(data) as n").groupBy("part").sum("n").collect()
    assert max(r[1] for r in parts) <= 3 * toxicity.SENT_BYTES


def test_chunks_as_arrays_give_what_lists_give():
    """Words, letters and languages of plain and odd chunks, worked out for all at once and one by one."""
    rng = np.random.default_rng(4)
    letters = list("abcXYZ09'-,.éİΣß中́²\xa0\U0001f600_")
    texts = [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(rng.integers(0, 12))) for _ in range(400)] + ["", "ΑΣ ΣΑΣ", "!! ?? '"]
    names, index, bounds = toxicity.chunk_tokens.split(pa.array(texts))
    shown = [("".join(filter(str.isalnum, x)) or x).lower() for x in names.to_pylist()]
    for part in (slice(None), slice(50, 60)):
        assert words.letters_and_digits(names[part]).to_pylist() == shown[part]
        found, at, number = words.letter_runs(names[part], language_id.split)
        assert found.take(pa.array(at)).to_pylist() == [w for x in names[part].to_pylist() for w in language_id.split(x)] and len(number) == len(shown[part])
    model = language_id.LanguageModel.of({"de": {"straße": 5, "abc": 1}, "el": {"ας": 2, "x": 3}})
    one, two = model.answer(names, index, bounds), model.answer(names.to_pylist(), index, bounds)
    assert one[0] == two[0] and np.array_equal(one[1], two[1])


def test_toxicity_trains_on_long_texts_in_blocks(monkeypatch):
    """A text that is longer than a block, and texts shorter than the filters, learn as if there were no blocks."""
    texts, toxic = pa.array([" ".join(f"w{i % 37}" for i in range(90)) + " zorgl", "aa bb", "cc", "", "aa cc dd bb"] * 4), np.array([1, 0, 0, 0, 1] * 4)
    whole = toxicity.ToxicityModel().fit(texts, toxic)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    parts = toxicity.ToxicityModel().fit(texts, toxic)
    assert np.allclose(whole.rows, parts.rows, atol=1e-4) and np.allclose(whole.out, parts.out, atol=1e-4)
    assert np.allclose(whole._all(texts), parts._all(texts), atol=1e-3)
