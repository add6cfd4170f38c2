"""Formats, organized trees, keyword search, pages, git history, vectors and the cache."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.operators import output, search, semantic, stats
from quarry.plans import cel
from quarry.sources import files, git


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("d/a.md", "markdown", 10, "Hi", ["x", "y"], "red fox red fox"), ("d/b.txt", "text", 20, None, None, "red sun"), ("e/a.md", "markdown", 30, "../..", [], "quick fox")],
        "path string, content_type string, size long, title string, tags array<string>, body string",
    )


def lines_of(df):
    return sorted(r.value for r in df.collect())


def test_formats(rows):
    found = [json.loads(x) for x in lines_of(output.ndjson(rows))]
    assert found[0] == {"path": "d/a.md", "content_type": "markdown", "size": 10, "title": "Hi", "tags": ["x", "y"]} and "title" not in found[1]
    assert lines_of(output.bare(rows)) == ["d/a.md", "d/b.txt", "e/a.md"] and lines_of(output.default(rows))[1] == "d/b.txt\ttext"
    assert lines_of(output.verbose(rows))[0] == "d/a.md [markdown] 10 bytes\n  title: Hi\n  tags: x, y"
    assert lines_of(output.template(rows, "{{.Path}}={{ .Title }}!"))[:2] == ["d/a.md=Hi!", "d/b.txt=!"]
    with pytest.raises(ValueError, match="Nope"):
        output.template(rows, "{{.Nope}}")


def test_sarif(rows):
    log = json.loads(output.sarif(rows.withColumn("line", F.lit(3)), "r1", "a rule", F.concat(F.lit("m" * 300), "path")).first().value)
    assert log["version"] == "2.1.0" and log["runs"][0]["tool"]["driver"]["rules"][0]["id"] == "r1"
    results = log["runs"][0]["results"]
    assert [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in results] == ["d/a.md", "d/b.txt", "e/a.md"]
    assert results[0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 3} and len(results[0]["message"]["text"]) == 201
    assert json.loads(output.sarif(rows.limit(0), "r1", "a rule", F.lit("m"), line=None).first().value)["runs"][0]["results"] == []


def test_organize(spark, rows, tmp_path):
    plan = lambda form, how: {r.path: (r.target, r.action) for r in output.organize(rows, form, on_conflict=how).collect()}
    assert plan("o/{content_type}/{basename}", "number") == {"d/a.md": ("o/markdown/a.md", "create"), "d/b.txt": ("o/text/b.txt", "create"), "e/a.md": ("o/markdown/a (1).md", "create")}
    assert plan("o/{stem}.{ext}", "skip")["e/a.md"] == ("o/a.md", "skip") and plan("o/{stem}.{ext}", "overwrite")["e/a.md"] == ("o/a.md", "overwrite")
    assert plan("{title}/{tags}/{no_such}/{mtime_year}/{basename}", "skip")["e/a.md"][0] == "_/unknown/unknown/unknown/a.md"
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("one")
    planned = spark.createDataFrame([(f"{tmp_path}/d/a.md", f"{tmp_path}/o/x/a.md", "create"), (f"{tmp_path}/d/none", f"{tmp_path}/o/none", "create"), (f"{tmp_path}/d/a.md", f"{tmp_path}/o/y", "skip")], "path string, target string, action string")
    assert sorted(r.done for r in output.materialize(planned, copy=True).collect()) == ["copied", "failed", "skipped"]
    assert (tmp_path / "o/x/a.md").read_text() == "one" and sorted(r.done for r in output.materialize(planned.limit(1)).collect()) == ["skipped"]


def test_keywords_rank_and_hybrid(rows):
    found = [(r.path, r.rank) for r in search.search(rows, keywords="red fox").collect()]
    assert found[0][0] == "d/a.md" and [x for _, x in found] == sorted((x for _, x in found), reverse=True)
    only = search.search(rows, 'content_type == "markdown"', keywords="red fox", rank="bm25 * -1.0").collect()
    assert [r.path for r in only] == ["e/a.md", "d/a.md"]
    scored = rows.withColumn("similarity", F.when(F.col("path") == "e/a.md", 0.9).otherwise(0.1))
    assert [r.path for r in search.search(scored, keywords="red fox", hybrid=True, limit=2).collect()] == ["d/a.md", "e/a.md"]
    assert [r.path for r in search.search(scored, threshold=0.5).collect()] == ["e/a.md"] and search.search(scored, threshold=0).count() == 3
    with pytest.raises(ValueError):
        search.search(rows, hybrid=True)
    assert search.above("a || b", 1) == "(a || b) && similarity >= double(1.0)"
    with pytest.raises(cel.ExpressionError):
        search.search(rows, fields=["nope"])


@pytest.mark.parametrize("orders", [["asc", "asc"], ["desc", "asc"], ["asc", "desc"], ["desc", "desc"]])
def test_tuple_pages_give_every_row_once(spark, orders):
    table = spark.createDataFrame([(None if i % 5 == 0 else i % 4, f"k{i:02}") for i in range(23)], "n int, k string")
    seen, token = [], None
    while True:
        page, following = search.tuple_page(table, ["n", "k"], orders, 4, scope="s", token=token)
        seen += [(r.n, r.k) for r in page.collect()]
        more = following.collect()
        if not more:
            break
        token = more[0].cursor
    rank = lambda n: (n is not None, n or 0)
    want = sorted(((r.n, r.k) for r in table.collect()), key=lambda r: r[1], reverse=orders[1] == "desc")
    assert seen == sorted(want, key=lambda r: rank(r[0]), reverse=orders[0] == "desc")
    with pytest.raises(ValueError):
        search.tuple_page(table, ["n", "k"], orders, 4, scope="other", token=search.tuple_page(table, ["n", "k"], orders, 4, scope="s")[1].first().cursor)


def test_git_history(spark, tmp_path):
    run = lambda *a, at: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at})
    run("init", "-q", at="2024-01-01T00:00:00Z")
    for k, (name, text) in enumerate([("a.txt", "1"), ("b é.txt", "1"), ("a.txt", "2")]):
        (tmp_path / name).write_text(text)
        run("add", ".", at="2024-01-01T00:00:00Z")
        run("commit", "-q", "-m", f"change {k}", at=f"2024-01-0{k + 1}T00:00:00Z")
    log = git.git_log(spark, str(tmp_path), str(tmp_path / "none"))
    got = {r.path.rsplit("/", 1)[-1]: r for r in log.collect()}
    assert set(got) == {"a.txt", "b é.txt"} and (got["a.txt"].commit_count, got["a.txt"].last_subject, got["a.txt"].last_author) == (2, "change 2", "Ann")
    assert got["a.txt"].last_commit_time.day == 3 and got["a.txt"].first_seen.day == 1
    joined = stats.with_git(files.walk(spark, str(tmp_path)).drop("content", "head"), log)
    assert joined.where("is_git_tracked").count() == 2


def test_vectors_are_made_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [None if len(t) > 5000 else [float(len(t)), 1.0] for t in texts]

    schema = "path string, size long, mod_time timestamp_ntz, body string"
    make = lambda *r: spark.createDataFrame(r, "path string, size long, m string, body string").selectExpr("path", "size", "to_timestamp_ntz(m) mod_time", "body")
    first = make(("a", 3, "2024-01-01 00:00:00", "abc"), ("b", 9000, "2024-01-01 00:00:00", "x" * 9000), ("c", 0, "2024-01-01 00:00:00", ""))
    assert first.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    folder = str(tmp_path / "vectors")
    found = {(r.path, r.chunk_id): r.vec for r in semantic.index(first, folder, model, "m1").collect()}
    assert set(found) == {("a", 0), ("b", 0), ("b", 1)} and abs(sum(x * x for x in found["b", 0]) - 1) < 1e-5
    before = calls.value
    again = make(("a", 3, "2024-01-01 00:00:00", "abc"), ("b", 4, "2024-02-01 00:00:00", "abcd"))
    assert {(r.path, r.size) for r in semantic.index(again, folder, model, "m1").collect()} == {("a", 3), ("b", 4)}
    assert calls.value == before + 1
    assert semantic.index(again, folder, model, "m2").count() == 2
    semantic.prune(again, folder)
    assert semantic.read(spark, folder).count() == 4
    near = semantic.with_similarity(again, semantic.read(spark, folder), semantic.embed_query(model, "abc"))
    assert {r.path: round(r.similarity, 6) for r in near.collect()}["a"] == 1.0


def test_cache_list_and_evict(spark, tmp_path):
    for name in ("x/a.md", "x/b.txt", "y/c.txt"):
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("words here")
    found, folder = files.detected(files.walk(spark, str(tmp_path / "tree"))), str(tmp_path / "cache")
    assert files.cached(found, folder).count() == 3
    assert [r.path.rsplit("/", 1)[-1] for r in files.cache_list(spark, folder, f"{tmp_path}/tree/x").collect()] == ["a.md", "b.txt"]
    assert files.cache_evict(spark, folder, f"{tmp_path}/tree/x") == 2
    assert files.cache_list(spark, folder).count() == 1 and files.cached(found, folder).count() == 3


def test_whole_bodies_options_and_profiles(spark, tmp_path):
    (tmp_path / "long.txt").write_text("word\n" * 400_000)
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x02\0\0\0\x03\x08")
    whole = {r.name: r for r in files.scan(spark, str(tmp_path)).select("name", "line_count", "word_count", "img_width").collect()}
    assert (whole["long.txt"].line_count, whole["long.txt"].word_count, whole["p.png"].img_width) == (400_000, 400_000, 2)
    cut = {r.name: r for r in files.scan(spark, str(tmp_path), body_bytes=1000, profile="code").select("name", "line_count", "is_body_truncated", "content_type", "img_width").collect()}
    assert (cut["long.txt"].line_count, cut["long.txt"].is_body_truncated) == (200, True)
    assert (cut["p.png"].content_type, cut["p.png"].img_width) == ("image/png", None)


def test_duplicate_members(spark):
    rows = spark.createDataFrame([(f"p{i}", 3, "abc" if i < 40 else f"x{i:02}") for i in range(60)], "path string, size long, body string")
    found = stats.duplicate_members(rows).collect()
    assert len(found) == 40 and {r["count"] for r in found} == {40}
    assert "paths" not in stats.duplicates(rows, paths=False).columns
