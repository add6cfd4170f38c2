"""Registered queries over rows that stand for files: presets, detection, parsers, source symbols and output, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph, output, reports, search, stats
from quarry.plans.catalog import FILES, _calls, _chunks, _trees, _TREES, docs, query, vec_sql, _PROBE, _CHAIN
from quarry.operators import relevance
from quarry.sources import files, symbols, tables

# ---------------------------------------------------------------- presets

_KINDS = ["markdown", "source/python", "epub", "text", "source/go"]


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """documents as files of several types with times, git columns and measures, all by arithmetic on doc_id."""
    rows, i = docs(spark, d), F.col("doc_id")
    return rows.withColumns(
        {
            "content_type": F.get(F.array(*map(F.lit, _KINDS)), (i % 5).cast("int")),
            "mod_time": F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 400 as int))"),
            "draft": i % 3 == 0,
            "is_git_tracked": i % 2 == 0,
            "is_git_ignored": i % 7 == 0,
            "git_commit_count": i % 11,
            "git_last_commit_time": F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 300 as int))"),
            "max_complexity": i % 13,
            "loc": i % 101,
            "is_test_file": i % 6 == 0,
            "is_generated_code": i % 8 == 0,
            "title": F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("T"), i)),
            "author": F.when(i % 9 == 0, "").otherwise("A"),
            "name": F.concat(F.lpad(i.cast("string"), 8, "0"), F.lit(".txt")),
        }
    )


_TREE = f"""{FILES}, tree AS (SELECT *, ['markdown', 'source/python', 'epub', 'text', 'source/go'][doc_id % 5 + 1] AS content_type, TIMESTAMP '2024-01-01' + to_days((doc_id % 400)::INT) AS mod_time,
    doc_id % 5 IN (1, 4) AS src, doc_id % 5 = 2 AS epub, doc_id % 2 = 0 AS tracked, lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS name FROM files)"""
_SINCE = "2024-12-01T00:00:00Z"


def _preset(name: str, where: str, order: str = "", limit: int | None = None) -> None:
    def run(spark, d):
        return search.preset(_tree(spark, d), name, _SINCE).select("path", "content_type")

    run.__name__ = f"preset_{name}"
    run.__doc__ = f"The named query {name}."
    cut = (f" ORDER BY {order}, path" if order else "") + (f" LIMIT {limit}" if limit else "")
    query(f"WITH {_TREE} SELECT path, content_type FROM tree WHERE {where}{cut}")(run)


_preset("recent_changes", "mod_time > TIMESTAMP '2024-12-01'", "mod_time DESC", 50)
_preset("old_drafts", "content_type = 'markdown' AND doc_id % 3 = 0 AND mod_time < TIMESTAMP '2024-12-01'", "mod_time")
_preset("large_files", "size > 100000000")
_preset("failed_tests", r"src AND doc_id % 6 = 0 AND regexp_matches(body, '(?m)^\s*(//|#|--|;)\s*\b(FAIL|FIXME|XXX|TODO)\b')")
_preset("recent_commits", "doc_id % 300 > 335", "doc_id % 300 DESC", 50)
_preset("hot_files", "tracked AND doc_id % 11 > 0", "doc_id % 11 DESC", 20)
_preset("hotspots", "src AND tracked AND doc_id % 11 > 0 AND doc_id % 13 > 0", "(doc_id % 13) * (doc_id % 11) DESC", 20)
_preset("prod_code", "src AND tracked AND doc_id % 6 <> 0 AND doc_id % 8 <> 0", "doc_id % 101 DESC", 100)
_preset("untracked_code", "src AND NOT tracked AND doc_id % 7 <> 0", "size DESC", 50)
_preset("generated_code", "src AND doc_id % 8 = 0", "size DESC", 50)
_preset("test_files", "src AND doc_id % 6 = 0", "doc_id % 101 DESC", 50)
_preset("large_ebooks", "epub", "size DESC", 20)
_preset("recent_ebooks", "epub AND mod_time > TIMESTAMP '2024-12-01'", "mod_time DESC", 50)
_preset("untagged_ebooks", "epub AND (doc_id % 4 = 0 OR doc_id % 9 = 0)", "name")
_preset("non_english_ebooks", "epub AND language <> 'en'", "name")
_preset("suspicious_files", "false")
_preset("system_metadata", "false")
_preset("large_binaries", "false")
_preset("recent_photos", "false")


# ---------------------------------------------------------------- search


@query(f"WITH {FILES} SELECT path FROM files WHERE len(list_filter([language, source], lambda t: starts_with(t, 'src1'))) > 0 AND len(list_filter([language, source], lambda t: length(t) > 1)) = 2 AND NOT language = 'en'")
def search_macros(spark, d):
    tagged = docs(spark, d).withColumn("tags", F.array("language", "source"))
    return search.where(tagged, 'tags.exists(t, t.startsWith("src1")) && tags.all(t, t.size() > 1) && tags.filter(t, t != "en").size() == 2').select("path")


@query(f"WITH {FILES}, m AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 50 END AS loc FROM files) SELECT path, loc FROM m ORDER BY loc DESC NULLS FIRST, path LIMIT 400")
def search_missing_order(spark, d):
    """Rows without the sort key come first when it falls."""
    rows = docs(spark, d).withColumn("loc", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50))
    return search.search(rows, sort="loc", order="desc", limit=400).select("path", "loc")


@query(f"WITH {FILES} SELECT path, size FROM files")
def search_empty_expression(spark, d):
    """No expression keeps all files; an unknown sort key and a limit of 0 change nothing."""
    return search.search(docs(spark, d), "", sort="no_such_key", limit=0).select("path", "size")


@query(f"WITH {FILES} SELECT path, (doc_id % 101) / 100.0::DOUBLE AS similarity FROM files WHERE size > 300 AND doc_id % 101 >= 80 ORDER BY similarity DESC, path LIMIT 60")
def search_similarity_threshold(spark, d):
    rows = docs(spark, d).withColumn("similarity", F.col("doc_id") % 101 / 100.0)
    return search.search(rows, "size > 300", threshold=0.8, limit=60).select("path", "similarity")


_TERMS = ["idiot", "reered", "the"]
_TF = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(_TERMS))
_DF = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(3))
_SCORE = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * length / mean))" for i in range(3))
_KEYED = rf"""{FILES}, k AS (SELECT path, doc_id, list_filter(string_split_regex(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2) AS t FROM files WHERE language = 'en'),
    c AS (SELECT path, doc_id, len(t) AS length, {_TF} FROM k), m AS (SELECT count(*) AS n, avg(length) AS mean, {_DF} FROM c), s AS (SELECT path, doc_id, {_SCORE} AS bm25 FROM c, m)"""


@query(f"WITH {_KEYED} SELECT path, round(bm25, 6) AS bm25 FROM s ORDER BY s.bm25 DESC, path LIMIT 30")
def search_keywords(spark, d):
    """BM25 over the files that pass the filter."""
    found = search.search(docs(spark, d), 'language == "en"', keywords="idiot the reered", limit=30)
    return found.select("path", F.round("bm25", 6).alias("bm25"))


@query(f"""WITH {_KEYED}, r AS (SELECT path, row_number() OVER (ORDER BY bm25 DESC, path) AS pa, row_number() OVER (ORDER BY doc_id % 997 DESC, path) AS pb FROM s)
    SELECT path, round(1.0::DOUBLE / (60 + pa) + 1.0::DOUBLE / (60 + pb), 9) AS rank FROM r ORDER BY 1.0::DOUBLE / (60 + pa) + 1.0::DOUBLE / (60 + pb) DESC, path LIMIT 30""")
def search_hybrid(spark, d):
    rows = docs(spark, d).withColumn("similarity", F.col("doc_id") % 997 / 1000.0)
    found = search.search(rows, 'language == "en"', keywords="idiot the reered", hybrid=True, limit=30)
    return found.select("path", F.round("rank", 9).alias("rank"))


@query("SELECT o_custkey, o_orderdate::VARCHAR AS day, o_orderkey FROM orders WHERE o_custkey < 700 OR (o_custkey = 700 AND o_orderkey > 20) ORDER BY o_custkey DESC, o_orderkey LIMIT 40")
def tuple_page(spark, d):
    """The second page of orders by falling customer and rising key."""
    orders = tables.table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"), "o_orderkey")
    import base64
    import json

    token = base64.urlsafe_b64encode(json.dumps({"scope": "orders", "orders": ["desc", "asc"], "key": ["700", "20"]}).encode()).decode()
    return search.tuple_page(orders, ["o_custkey", "o_orderkey"], ["desc", "asc"], 40, scope="orders", token=token)[0]


@query(f"""WITH s AS (SELECT printf('docs/f%05d', vec_id // 4) AS path, max({vec_sql()}) AS s FROM embeddings GROUP BY 1) SELECT path, round(s, 6) AS similarity FROM s WHERE s >= 0.05 ORDER BY s DESC, path LIMIT 25""")
def search_semantic(spark, d):
    """Vectors joined to files, a threshold and the best first."""
    from quarry.operators import semantic

    vectors = _chunks(spark, d).withColumn("path", F.concat(F.lit("docs/"), "path"))
    rows = semantic.with_similarity(vectors.select("path").distinct().withColumn("size", F.lit(1)), vectors, _PROBE)
    return search.search(rows, threshold=0.05, limit=25).select("path", F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- sets and reports


@query(f"WITH {_TREES} SELECT path_b, sha256, 'only_b' AS status FROM b WHERE sha256 NOT IN (SELECT sha256 FROM a)")
def diff_b_minus_a(spark, d):
    return stats.diff(*_trees(spark, d), "b-minus-a").select("path_b", "sha256", "status")


@query(f"""WITH {FILES}, h AS (SELECT path, size, sha256(body) AS sha256 FROM files WHERE size > 0) SELECT sha256, path, size, n AS count FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS n FROM h) WHERE n > 1""")
def duplicate_members(spark, d):
    return stats.duplicate_members(docs(spark, d))


@query("""WITH n AS (SELECT o_custkey AS s, max(o_orderkey % 31) AS v FROM orders GROUP BY 1), b AS (SELECT o_custkey AS s, max(o_orderkey % 29) AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT CASE WHEN bool_or(v > 15 AND v > coalesce(o, 0)) THEN 'fail' WHEN bool_or(v > 15) THEN 'warn' ELSE 'pass' END AS verdict, count(*) AS checked FROM n LEFT JOIN b USING (s)""")
def review_overall(spark, d):
    o = tables.table(spark, d, "orders")
    side = lambda rows, n: rows.select(F.lit("x").alias("path"), F.col("o_custkey").alias("symbol"), (F.col("o_orderkey") % n).alias("value"))
    return reports.verdict(reports.review(side(o, 31), side(o.where("o_orderstatus = 'F'"), 29)))


@query("SELECT count(*) AS files, count(*) FILTER (WHERE doc_id % 8 = 0) AS generated, count(*) FILTER (WHERE doc_id % 8 = 0) >= 3 AND count(*) FILTER (WHERE doc_id % 8 = 0) * 100 >= count(*) * 34 AS hint FROM documents")
def generated_hint(spark, d):
    return reports.generated_hint(_tree(spark, d))


@query("""SELECT 'p/' || a || '.heic' AS image_path, 'p/' || a || '.MOV' AS video_path, s AS video_size FROM (SELECT doc_id AS a, doc_id + 5 AS s FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 2 = 0)""")
def live_photo_pairs(spark, d):
    i = tables.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("s"))
    row = lambda rows, end: rows.select(F.concat(F.lit("p/"), "s", F.lit(end)).alias("path"), F.lit("p").alias("dir"), F.concat("s", F.lit(end)).alias("name"), F.lower(F.lit(end)).alias("ext"), (F.col("doc_id") + 5).alias("size"))
    return stats.live_photos(row(i.where("doc_id % 3 <> 1"), ".heic").unionByName(row(i.where("doc_id % 2 = 0"), ".MOV")))


# ---------------------------------------------------------------- output


@query(f"""WITH {FILES} SELECT '{{"path":"' || path || '","content_type":"text","size":' || size || '}}' AS value FROM files WHERE size > 5000""")
def output_ndjson(spark, d):
    return output.ndjson(search.search(docs(spark, d), "size > 5000", fields=[]))


@query(f"WITH {FILES} SELECT path || ' has ' || size || ' bytes in ' || language AS value FROM files WHERE size > 5000")
def output_template(spark, d):
    return output.template(search.where(docs(spark, d), "size > 5000"), "{{.Path}} has {{ .Size }} bytes in {{.Language}}")


@query(f"WITH {FILES} SELECT path || chr(9) || 'text' AS value FROM files WHERE size > 5000")
def output_default(spark, d):
    return output.default(search.where(docs(spark, d), "size > 5000"))


@query(f"""WITH {FILES}, t AS (SELECT path, 'sorted/' || language || '/' || (doc_id % 40) || '.txt' AS target FROM files), n AS (SELECT path, target, row_number() OVER (PARTITION BY target ORDER BY path) - 1 AS k FROM t)
    SELECT path, CASE WHEN k = 0 THEN target ELSE regexp_replace(target, '\\.txt$', ' (' || k || ').txt') END AS target, 'create' AS action FROM n""")
def organize_targets(spark, d):
    rows = docs(spark, d).withColumn("group", (F.col("doc_id") % 40).cast("string"))
    return output.organize(rows, "sorted/{language}/{group}.txt", on_conflict="number")


@query(f"""WITH {FILES} SELECT path, 1 AS line, '{{"ruleId":"size","level":"note","message":{{"text":"' || size || ' bytes"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}},"region":{{"startLine":1}}}}}}]}}' AS result FROM files WHERE size > 5000""")
def sarif_results(spark, d):
    rows = search.where(docs(spark, d), "size > 5000").withColumn("line", F.lit(1))
    found = output.sarif_results(rows, "size", F.concat(F.col("size").cast("string"), F.lit(" bytes")), level="note")
    return found.withColumn("result", F.to_json("result"))


# ---------------------------------------------------------------- detection and parsers


def _made(spark: SparkSession, d: str, name, content) -> DataFrame:
    """Rows as files: one for each document, with a name and content made from its columns."""
    rows = tables.table(spark, d, "documents").select("doc_id", "lang", "source", name.alias("name"), content.cast("binary").alias("content"))
    return rows.withColumns({"path": F.concat(F.lit("made/"), "name"), "dir": F.lit("made"), "ext": F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)), "size": F.length("content").cast("bigint"), "mod_time": F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")})


def _parsed(spark: SparkSession, d: str, ending: str, content) -> DataFrame:
    return files.attributes(files.detected(_made(spark, d, F.concat(F.lit("d"), "doc_id", F.lit(ending)), content)))


_ENDINGS = {".md": "markdown", ".py": "source/python", ".go": "source/go", ".csv": "csv", ".json": "json", ".html": "html", ".yaml": "yaml", ".eml": "email/rfc822", ".txt": "text", ".png": "image/png"}


@query(f"""SELECT doc_id, [{", ".join(f"'{k}'" for k in _ENDINGS.values())}][doc_id % 10 + 1] AS content_type,
    CASE WHEN doc_id % 4 = 0 THEN 'pdf' ELSE '' END AS magic_content_type, doc_id % 4 = 0 AS is_disguised FROM documents""")
def detect_types(spark, d):
    """Types by ending; every fourth file begins like a PDF, so it is disguised."""
    ending = F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 10).cast("int"))
    rows = _made(spark, d, F.concat(F.lit("d"), "doc_id", ending), F.when(F.col("doc_id") % 4 == 0, "%PDF-1.7 x").otherwise("plain"))
    return files.detected(rows).select("doc_id", "content_type", "magic_content_type", "is_disguised")


@query("""SELECT doc_id, 'Title ' || doc_id AS title, doc_id % 2 = 0 AS draft, lang || ',' || source AS tags, 2 AS word_count FROM documents""")
def markdown_frontmatter(spark, d):
    content = F.expr("concat('---\\ntitle: Title ', doc_id, '\\ntags: [', lang, ', ', source, ']\\ndraft: ', if(doc_id % 2 = 0, 'true', 'false'), '\\n---\\nHello there\\n')")
    return _parsed(spark, d, ".md", content).select("doc_id", "title", "draft", F.array_join("tags", ",").alias("tags"), F.col("word_count").cast("int").alias("word_count"))


@query("SELECT doc_id, 'id,name ' || doc_id || ',' || lang AS csv_columns, 3 AS column_count FROM documents")
def csv_header(spark, d):
    content = F.expr("concat('id,\"name ', doc_id, '\",', lang, '\\n1,2,3\\n')")
    return _parsed(spark, d, ".csv", content).select("doc_id", F.array_join("csv_columns", ",").alias("csv_columns"), F.col("column_count").cast("int").alias("column_count"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'object' ELSE 'array' END AS json_kind FROM documents")
def json_kinds(spark, d):
    return _parsed(spark, d, ".json", F.expr("if(doc_id % 2 = 0, ' {\"a\": 1}', '[1]')")).select("doc_id", "json_kind")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'mapping' ELSE 'sequence' END AS yaml_kind, (doc_id % 3 + 1)::INT AS documents FROM documents")
def yaml_kinds(spark, d):
    content = F.expr("concat_ws('---\\n', transform(sequence(0, cast(doc_id % 3 as int)), i -> if(doc_id % 2 = 0, 'a: 1\\n', '- x\\n')))")
    return _parsed(spark, d, ".yaml", content).select("doc_id", "yaml_kind", F.col("yaml_document_count").cast("int").alias("documents"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'library' ELSE 'ns:root' END AS root_element FROM documents")
def xml_roots(spark, d):
    return _parsed(spark, d, ".xml", F.expr("concat('<?xml version=\"1.0\"?>\\n<', if(doc_id % 2 = 0, 'library', 'ns:root'), ' a=\"1\"/>')")).select("doc_id", "root_element")


@query("SELECT doc_id, 'Subject ' || doc_id AS title, 'a' || doc_id || '@x.org' AS author, 'b@x.org,c' || (doc_id % 7) || '@x.org' AS email_to, 'm' || doc_id AS message_id, 'Hello ' || lang AS body FROM documents")
def mail_attributes(spark, d):
    content = F.expr("concat('From: a', doc_id, '@x.org\\nTo: b@x.org, C <c', doc_id % 7, '@x.org>\\nSubject: Subject ', doc_id, '\\nMessage-ID: <m', doc_id, '>\\n\\nHello ', lang, '\\n')")
    rows = _parsed(spark, d, ".eml", content)
    return rows.select("doc_id", "title", "author", F.array_join("email_to", ",").alias("email_to"), F.col("email_message_id").alias("message_id"), F.trim(F.regexp_replace("body", r"\s+$", "")).alias("body"))


# ---------------------------------------------------------------- source symbols

_GO_FILE = """concat('package p\\n\\nimport "m', doc_id % 5, '"\\n\\ntype T', doc_id, ' struct{ F *T', doc_id div 2, ' }\\n\\n// F', doc_id, ' calls.\\nfunc F', doc_id, '(a int) {\\n', repeat('\\tif a > 1 && a < 9 {\\n\\t}\\n', cast(doc_id % 4 as int)), '\\tF', doc_id div 2, '(a)\\n\\tm.Use(H', doc_id % 10, ')\\n}\\n')"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A Go file for each document: its function calls that of half its number and hands one of ten handlers on."""
    return tables.table(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id") % 3, F.lit("/f"), "doc_id", F.lit(".go")).alias("path"), F.lit("go").alias("language"), F.expr(_GO_FILE).alias("body"))


_SRC = "s AS (SELECT doc_id AS i, 'p' || (doc_id % 3) || '/f' || doc_id || '.go' AS path FROM documents)"


@query(f"WITH {_SRC} SELECT path, 'F' || i AS caller, unnest(['F' || (i // 2), 'Use']) AS callee FROM s")
def source_calls(spark, d):
    return symbols.symbols(_sources(spark, d)).select("path", F.explode("calls").alias("c")).select("path", "c.caller", "c.callee")


@query(f"WITH {_SRC} SELECT path, 'F' || i AS function, (1 + 2 * (i % 4))::INT AS complexity, 8 AS start_line, (11 + 2 * (i % 4))::INT AS end_line FROM s")
def source_complexity(spark, d):
    found = symbols.symbols(_sources(spark, d)).select("path", F.explode("spans").alias("s"))
    return found.select("path", "s.function", "s.complexity", "s.start_line", "s.end_line")


@query(f"WITH {_SRC} SELECT path, unnest(['function', 'type']) AS kind, unnest(['F' || i, 'T' || i]) AS symbol, 'm' || (i % 5) AS module FROM s")
def source_definitions(spark, d):
    found = symbols.symbols(_sources(spark, d))
    return found.select("path", F.explode("defs").alias("d"), F.element_at("imports", 1).alias("module")).select("path", "d.kind", "d.symbol", "module")


@query(f"WITH {_SRC} SELECT path, (10 + 2 * (i % 4))::INT AS line, 'value' AS kind, 'go' AS language FROM s WHERE i % 10 = 7")
def source_references(spark, d):
    """Where the handler H7 is handed on."""
    return graph.references(graph.build(_sources(spark, d)), "H7")


@query(f"WITH {_SRC}, u AS (SELECT DISTINCT i // 2 AS i FROM s) SELECT path, unnest(['F' || i, 'T' || i]) AS symbol, unnest(['function', 'type']) AS kind FROM s WHERE i NOT IN (SELECT i FROM u)")
def source_dead_code(spark, d):
    g = graph.build(_sources(spark, d))
    return graph.dead_code(g["defs"], g["refs"]).select("path", "symbol", "kind")


@query(f"""WITH RECURSIVE {_CHAIN}, r AS (SELECT 'c2' AS symbol, 0 AS depth UNION ALL SELECT e.caller, r.depth + 1 FROM e JOIN r ON e.callee = r.symbol WHERE r.depth < 2)
    SELECT 'caller' AS relation, caller AS symbol, 1 AS depth FROM e WHERE callee = 'c2' UNION ALL SELECT 'callee', callee, 1 FROM e WHERE caller = 'c2'
    UNION ALL SELECT 'dependent', symbol, min(depth)::INT FROM r WHERE depth > 0 GROUP BY symbol""")
def graph_trace(spark, d):
    return graph.trace(_calls(spark, d), "c2", 2)


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' ELSE 'c' END AS language, doc_id % 3 < 2 AND doc_id % 4 = 0 AS is_generated_code FROM documents")
def generated_marks(spark, d):
    """A mark counts in the language that has it, in the first twenty lines."""
    mark = "CASE doc_id % 3 WHEN 0 THEN '// Code generated by x. DO NOT EDIT.' WHEN 1 THEN '# AutoGenerated' ELSE '// generated by x' END"
    body = F.expr(f"concat(repeat('\\n', if(doc_id % 4 = 0, 19, 20)), {mark}, '\\n')")
    language = F.expr("CASE doc_id % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' ELSE 'c' END")
    rows = tables.table(spark, d, "documents").select("doc_id", language.alias("language"), body.alias("body"))
    return rows.select("doc_id", "language", files.generated(F.col("body"), F.col("language")).alias("is_generated_code"))


_TEST_NAMES = ["a_test.go", "test_a.py", "a.spec.tsx", "ATest.java", "testing.py", "a_tests.cpp", "x/tests/a.rs", "latest.rs", "T.t", "contest.cs"]


@query(f"""WITH n AS (SELECT doc_id, [{", ".join(f"'{n}'" for n in _TEST_NAMES)}][doc_id % 10 + 1] AS path FROM documents) SELECT doc_id, path, doc_id % 10 NOT IN (4, 7) AS is_test_file FROM n""")
def test_file_names(spark, d):
    languages = ["go", "python", "typescript", "java", "python", "cpp", "rust", "rust", "perl", "csharp"]
    i = (F.col("doc_id") % 10).cast("int")
    rows = tables.table(spark, d, "documents").select("doc_id", F.get(F.array(*map(F.lit, _TEST_NAMES)), i).alias("path"), F.get(F.array(*map(F.lit, languages)), i).alias("language"))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("doc_id", "path", files.test_file(name, F.col("path"), F.col("language")).alias("is_test_file"))
