"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars, text
from quarry.operators import graph, lines, near_duplicates, relevance, reports, search, stats
from quarry.sources import tables
from quarry.streaming import watch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: documents as files, in SQL.
FILES = """files AS (SELECT 'docs/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path,
    octet_length(encode(text))::BIGINT AS size, lang AS language, text AS body, doc_id, source,
    'docs/' || source || '/' || lang AS dir FROM documents)"""
#: The lines of a text as a line scanner gives them, in SQL.
LINES = r"""CASE WHEN body = '' THEN [] ELSE string_split(regexp_replace(body, '\n\z', ''), chr(10)) END"""
#: The links between pages, in SQL.
LINKS = """links AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)"""
_BM25_QUERY = "idiot the reered"
_PROBE = [((i * 37) % 64 - 31.5) / 148.0 for i in range(64)]


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.document_files(tables.table(spark, d, "documents"))


def vec_sql(column: str = "embedding") -> str:
    return " + ".join(f"{column}[{i + 1}]::DOUBLE * ({x!r})::DOUBLE" for i, x in enumerate(_PROBE))


@query(f"WITH {FILES} SELECT path, 'text' AS content_type, size, language FROM files WHERE size > 2000 AND language = 'de' ORDER BY size DESC, path LIMIT 10")
def search_filter_topk(spark, d):
    return search.search(docs(spark, d), 'size > 2000 && language == "de"', sort="size", order="desc", limit=10, fields=["language"])


@query(f"WITH {FILES} SELECT path, size FROM files WHERE size < 3000")
def search_missing_zero_default(spark, d):
    found = search.where(docs(spark, d), 'page_count < 5 && taken_at < timestamp("2000-01-01T00:00:00Z") && title == "" && size < 3000')
    return found.select("path", "size")


@query(f"WITH {FILES} SELECT path, (CASE WHEN language = 'fr' THEN 1.0 ELSE 0.0 END)::DOUBLE AS rank FROM files WHERE size > 500")
def search_rank_bool(spark, d):
    return search.ranked(search.where(docs(spark, d), "size > 500"), 'language == "fr"').select("path", "rank")


@query(f"WITH {FILES} SELECT path, (CASE WHEN size > 5000 THEN size::DOUBLE / 1000.0 ELSE -1.0 END)::DOUBLE AS rank FROM files ORDER BY rank DESC, path LIMIT 25")
def search_rank_ternary(spark, d):
    return search.search(docs(spark, d), rank="size > 5000 ? double(size) / 1000.0 : -1.0", limit=25).select("path", "rank")


@query(f"WITH {FILES} SELECT path FROM files WHERE (contains(body, 'idiot') OR starts_with(path, 'docs/src1/') OR regexp_matches(body, '[0-9]{{3}}-[0-9]{{4}}')) AND NOT ends_with(path, '7.txt')")
def search_string_methods(spark, d):
    return search.where(docs(spark, d), 'is_text && (body.contains("idiot") || path.startsWith("docs/src1/") || body.matches("[0-9]{3}-[0-9]{4}")) && !path.endsWith("7.txt")').select("path")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) - 1 = 2 AND o_orderstatus IN ('O', 'F') AND o_totalprice > 1000.0")
def search_time_and_list(spark, d):
    orders = tables.table(spark, d, "orders")
    return search.where(orders, 'o_orderdate.getFullYear() == 1996 && o_orderdate.getMonth() == 2 && o_orderstatus in ["O", "F"] && o_totalprice > 1000.0').select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey <> 7 AND (l_orderkey % (l_suppkey - 7)) = 3 AND (l_partkey // 3) > l_suppkey")
def search_error_drops(spark, d):
    """A division by zero drops its row."""
    items = tables.table(spark, d, "lineitem")
    return search.where(items, "l_orderkey % (l_suppkey - 7) == 3 && l_partkey / 3 > l_suppkey").select("l_orderkey", "l_linenumber")


@query(f"WITH {FILES} SELECT language AS bucket, count(*) AS count, sum(size)::BIGINT AS total_size FROM files GROUP BY 1")
def stats_by_language(spark, d):
    return stats.histogram(docs(spark, d), "language")


@query(f"WITH {FILES} SELECT source AS bucket, count(*) AS count, sum(size)::BIGINT AS total_size FROM files GROUP BY ROLLUP(source)")
def stats_by_source_totals(spark, d):
    return stats.totals(docs(spark, d), "source")


@query("SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS count, 0::BIGINT AS total_size FROM events GROUP BY 1")
def stats_events_day(spark, d):
    return stats.histogram(tables.table(spark, d, "events").withColumnRenamed("ts", "mod_time"), "mod_time_day")


@query(f"""WITH {FILES}, h AS (SELECT path, size, sha256(body) AS sha256 FROM files WHERE size > 0)
    SELECT sha256, min(size) AS size, count(*) AS count, (count(*) - 1) * min(size) AS wasted, string_agg(path, ',' ORDER BY path) AS paths FROM h GROUP BY sha256 HAVING count(*) > 1""")
def duplicates_exact(spark, d):
    return stats.duplicates(docs(spark, d)).withColumn("paths", F.array_join("paths", ","))


def _trees(spark, d):
    rel = docs(spark, d).withColumn("path", F.element_at(F.split("path", "/"), -1))
    return rel.where("source < 'src15'"), rel.where("source >= 'src15'")


_TREES = f"""{FILES}, t AS (SELECT lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path, source, sha256(body) AS sha256 FROM files WHERE size > 0),
    a AS (SELECT path AS path_a, sha256 FROM t WHERE source < 'src15'), b AS (SELECT path AS path_b, sha256 FROM t WHERE source >= 'src15')"""


@query(f"WITH {_TREES} SELECT path_a, sha256, 'only_a' AS status FROM a WHERE sha256 NOT IN (SELECT sha256 FROM b)")
def diff_minus(spark, d):
    return stats.diff(*_trees(spark, d), "a-minus-b").select("path_a", "sha256", "status")


@query(f"""WITH {_TREES}, x AS (SELECT sha256, min(path_a) AS path_a FROM a GROUP BY 1), y AS (SELECT sha256, min(path_b) AS path_b FROM b GROUP BY 1)
    SELECT path_a, path_b, sha256, 'both' AS status FROM x JOIN y USING (sha256)""")
def diff_intersect(spark, d):
    return stats.diff(*_trees(spark, d), "intersect").select("path_a", "path_b", "sha256", "status")


@query(f"""WITH {_TREES}, x AS (SELECT sha256, min(path_a) AS path_a FROM a GROUP BY 1), y AS (SELECT sha256, min(path_b) AS path_b FROM b GROUP BY 1)
    SELECT path_a, path_b, sha256, CASE WHEN path_b IS NULL THEN 'only_a' WHEN path_a IS NULL THEN 'only_b' ELSE 'both' END AS status FROM x FULL JOIN y USING (sha256)""")
def diff_union(spark, d):
    return stats.diff(*_trees(spark, d), "union").select("path_a", "path_b", "sha256", "status")


@query(f"""WITH {FILES}, t AS (SELECT source, (doc_id // 7)::VARCHAR AS path, sha256(body) AS sha256 FROM files WHERE size > 0)
    SELECT x.path AS path_a, x.sha256, y.sha256 AS sha256_b FROM t x JOIN t y USING (path) WHERE x.source < 'src15' AND y.source >= 'src15' AND x.sha256 <> y.sha256""")
def diff_mismatch(spark, d):
    rel = docs(spark, d).withColumn("path", F.expr("cast(doc_id div 7 as string)"))
    return stats.diff(rel.where("source < 'src15'"), rel.where("source >= 'src15'"), "mismatch").select("path_a", "sha256", "sha256_b")


@query(f"WITH {FILES} SELECT path, size FROM files WHERE size < 2000 OR (size = 2000 AND path > 'docs/src3') ORDER BY size DESC, path LIMIT 20")
def keyset_page(spark, d):
    token = search.cursor("size", "desc", 2000, "docs/src3")
    return search.page(docs(spark, d), "size", "desc", 20, token)[0].select("path", "size")


@query(f"""WITH {FILES}, l AS (SELECT path, {LINES} AS ls FROM files), n AS (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS line FROM l)
    SELECT path, line::INT AS line, ls[line] AS text, array_to_string(ls[greatest(line - 2, 1):line - 1], chr(10)) AS before, array_to_string(ls[line + 1:line + 1], chr(10)) AS after
    FROM n WHERE regexp_matches(ls[line], '(idiot|License|licensed)')""")
def grep_context(spark, d):
    found = lines.find_matches(docs(spark, d), "(idiot|License|licensed)", before=2, after=1)
    return found.withColumns({"before": F.array_join("before", "\n"), "after": F.array_join("after", "\n")})


@query(f"WITH {FILES} SELECT path, len({LINES})::INT AS total_lines, array_to_string(({LINES})[2:4], chr(10)) AS text FROM files")
def lines_range(spark, d):
    return lines.read_lines(docs(spark, d), 2, 4)


@query(f"WITH {FILES} SELECT path, array_to_string(({LINES})[1:3], chr(10)) AS snippet FROM files")
def snippet(spark, d):
    return docs(spark, d).select("path", text.snippet(F.col("body"), 3).alias("snippet"))


@query(f"WITH {FILES} SELECT path, len({LINES})::BIGINT AS line_count, len(regexp_extract_all(body, '\\S+'))::BIGINT AS word_count FROM files")
def word_line_count(spark, d):
    return docs(spark, d).select("path", text.line_count(F.col("body")).alias("line_count"), text.word_count(F.col("body")).alias("word_count"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^\n]*?)</title>', 1)) AS title, regexp_extract(html, '(?i)<html[^>]*\slang\s*=\s*["'']?([A-Za-z0-9-]+)', 1) AS lang FROM pages""")
def html_title_lang(spark, d):
    return tables.page_files(tables.table(spark, d, "pages")).select("page_id", "title", F.col("language").alias("lang"))


_TAGS = "p|div|li|tr|h[1-6]|section|article|ul|ol|table|blockquote"


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(t, '(?i)</(?:{_TAGS})\s*>|<br\s*/?>', chr(10), 'g') AS t FROM a),
    c AS (SELECT page_id, regexp_replace(t, '(?s)<!--.*?-->|<[^>]*>', '', 'g') AS t FROM b),
    d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM c)
    SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS text FROM d""")
def html_text(spark, d):
    return tables.page_files(tables.table(spark, d, "pages")).select("page_id", text.html_text(F.col("body")).alias("text"))


@query("""WITH l AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, CASE
    WHEN contains(t, 'apache license') AND contains(t, 'version 2.0') THEN 'Apache-2.0'
    WHEN contains(t, 'gnu affero general public license') THEN 'AGPL-3.0'
    WHEN contains(t, 'gnu lesser general public license') AND contains(t, 'version 3') THEN 'LGPL-3.0'
    WHEN contains(t, 'gnu general public license') AND contains(t, 'version 3') THEN 'GPL-3.0'
    WHEN contains(t, 'gnu general public license') AND (contains(t, 'version 2') OR contains(t, 'v2')) THEN 'GPL-2.0'
    WHEN contains(t, 'permission is hereby granted, free of charge') THEN 'MIT' ELSE '' END AS license_id FROM l""")
def license_id(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", scalars.license_id(F.col("text")).alias("license_id"))


def _secrets_sql() -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}' END" for k, p in sorted(scalars.SECRETS.items()))
    return f"SELECT doc_id, array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',') AS kinds FROM documents"


@query(_secrets_sql())
def secret_kinds(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.array_join(scalars.secret_kinds(F.col("text")), ",").alias("kinds"))


@query("SELECT c_custkey, levenshtein(c_name, 'Customer#000000777') AS distance FROM customer WHERE levenshtein(c_name, 'Customer#000000777') <= 2")
def levenshtein_names(spark, d):
    near = search.where(tables.table(spark, d, "customer"), 'levenshtein(c_name, "Customer#000000777") <= 2')
    return near.select("c_custkey", F.levenshtein("c_name", F.lit("Customer#000000777")).cast("bigint").alias("distance"))


@query("""WITH g AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: p_name[i:i + 2])) AS a,
    list_distinct(list_transform(range(1, length(p_type) - 1), lambda i: p_type[i:i + 2])) AS b FROM part)
    SELECT p_partkey, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS likeness FROM g""")
def ngram_similarity_parts(spark, d):
    return tables.table(spark, d, "part").select("p_partkey", F.round(scalars.ngram_similarity(F.col("p_name"), F.col("p_type"), F.lit(3)), 6).alias("likeness"))


@query(f"""WITH w AS (SELECT doc_id, upper(regexp_extract(text, '[A-Za-z]+', 0)) AS w FROM documents),
    c AS (SELECT doc_id, w, translate(w[1] || replace(replace(w[2:], 'H', ''), 'W', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') AS s FROM w),
    r AS (SELECT doc_id, w, {"regexp_replace(" * 6}s{"".join(f", '{i}+', '{i}', 'g')" for i in range(1, 7))} AS s FROM c)
    SELECT doc_id, CASE WHEN w = '' THEN '0000' ELSE rpad(left(w[1] || replace(s[2:], '0', ''), 4), 4, '0') END AS code FROM r""")
def soundex_names(spark, d):
    """The code of each document's first word of ASCII letters."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    return tables.table(spark, d, "documents").select("doc_id", scalars.soundex(word).alias("code"))


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 7919 % 1000) / 100.0 AS lat, (c_custkey * 104729 % 1000) / 100.0 AS lon FROM customer)
    SELECT c_custkey, CASE WHEN lat < 2 OR lat >= 8 THEN false ELSE lon < lat END AS inside FROM p""")
def point_in_polygon(spark, d):
    """A triangle with corners (2, 0), (2, 2), (8, 8), (8, 0) cut along lat = lon."""
    c = tables.table(spark, d, "customer")
    lat, lon = F.col("c_custkey") * 7919 % 1000 / 100.0, F.col("c_custkey") * 104729 % 1000 / 100.0
    polygon = F.array(*(F.lit(float(x)) for x in (2, -1, 2, 2, 8, 8, 8, -1)))
    return c.select("c_custkey", scalars.point_in_polygon(lat, lon, polygon).alias("inside"))


def _bm25_sql(scored: str) -> str:
    terms = relevance.query_terms(_BM25_QUERY)
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(terms)))
    part = lambda i: f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * length / mean))"
    return f"""WITH {FILES}, k AS (SELECT path, list_filter(string_split_regex(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2) AS t FROM files),
        c AS (SELECT path, len(t) AS length, {tf} FROM k), m AS (SELECT count(*) AS n, avg(length) AS mean, {df} FROM c),
        s AS (SELECT path, {" + ".join(part(i) for i in range(len(terms)))} AS bm25 FROM c, m) {scored}"""


@query(_bm25_sql("SELECT path, round(bm25, 6) AS bm25 FROM s ORDER BY s.bm25 DESC, path LIMIT 50"))
def bm25_topk(spark, d):
    return relevance.top_k(relevance.bm25(docs(spark, d), _BM25_QUERY), "bm25", 50).withColumn("bm25", F.round("bm25", 6))


@query(_bm25_sql(""", z AS (SELECT path, round(bm25, 9) AS a, (size % 997)::DOUBLE AS b FROM s JOIN files USING (path)),
    r AS (SELECT path, row_number() OVER (ORDER BY a DESC, path) AS pa, row_number() OVER (ORDER BY b DESC, path) AS pb FROM z)
    SELECT path, round(1.0::DOUBLE / (60 + pa) + 1.0::DOUBLE / (60 + pb), 9) AS rrf FROM r"""))
def rrf_hybrid(spark, d):
    files = docs(spark, d)
    other = files.select("path", (F.col("size") % 997).cast("double").alias("b"))
    scored = relevance.bm25(files, _BM25_QUERY).withColumn("bm25", F.round("bm25", 9))
    return relevance.fuse(scored, other, "bm25", "b").withColumn("rrf", F.round("rrf", 9))


def _chunks(spark, d):
    return tables.table(spark, d, "embeddings").select(F.format_string("f%05d", F.expr("vec_id div 4")).alias("path"), (F.col("vec_id") % 4).alias("chunk_id"), F.col("embedding").alias("vec"))


@query(f"SELECT printf('f%05d', vec_id // 4) AS path, round(max({vec_sql()}), 6) AS similarity FROM embeddings GROUP BY 1 ORDER BY max({vec_sql()}) DESC, path LIMIT 20")
def vector_topk(spark, d):
    return relevance.vector_top_k(_chunks(spark, d), _PROBE, 20).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH s AS (SELECT printf('f%05d', vec_id // 4) AS path, vec_id % 4 AS chunk_id, {vec_sql()} AS s FROM embeddings)
    SELECT path, chunk_id, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY s DESC, chunk_id) = 1""")
def vector_maxsim(spark, d):
    return relevance.best_chunk(_chunks(spark, d), _PROBE).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT doc_id, md5(text) IN (SELECT md5(text) FROM documents WHERE lang = 'de') OR sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src3') AS is_known_good FROM documents""")
def known_hash_flags(spark, d):
    files = docs(spark, d)
    body = F.col("body").cast("binary")
    hashes = files.where("language = 'de'").select(F.lit("md5").alias("algo"), F.md5(body).alias("hex")).unionByName(files.where("source = 'src3'").select(F.lit("sha256").alias("algo"), F.sha2(body, 256).alias("hex")))
    return stats.known_flags(files, hashes).select("doc_id", "is_known_good")


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hash_trio(spark, d):
    return stats.hash_trio(docs(spark, d)).select("doc_id", "md5", "sha1", "sha256")


@query("""SELECT conv_id, count(*) AS message_count, (SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT DISTINCT role AS r FROM conversations y WHERE y.conv_id = c.conv_id)) AS participants,
    string_agg(role || chr(9) || text, chr(10) ORDER BY turn, role, text) AS body FROM conversations c GROUP BY conv_id""")
def chat_summary(spark, d):
    return stats.chat_summary(tables.table(spark, d, "conversations"))


def _owned(spark, d):
    return docs(spark, d).select(F.col("source").alias("dir"), F.col("language").alias("git_last_commit_author"), (F.col("doc_id") % 9).alias("git_commit_count"))


@query("""WITH g AS (SELECT source AS dir, lang, count(*) AS n, sum(doc_id % 9) AS c FROM documents GROUP BY 1, 2)
    SELECT dir, sum(n)::BIGINT AS files, count(*) AS authors, arg_min(lang, (-n, lang)) AS top_author, max(n)::DOUBLE / sum(n) AS share, sum(c)::BIGINT AS commits FROM g GROUP BY 1""")
def churn_owners(spark, d):
    return stats.churn_owners(_owned(spark, d))


@query("""WITH f AS (SELECT DISTINCT l_suppkey AS s, (l_partkey % 50) * 20 AS a FROM lineitem), m AS (SELECT s, a, l_orderkey % 1000 AS at, l_linenumber AS n, l_quantity > 25 AS c FROM f JOIN lineitem ON l_suppkey = s AND l_orderkey % 1000 BETWEEN a AND a + 19)
    SELECT s::VARCHAR AS path, 'f' || a AS function, a AS start_line, sum(n)::BIGINT AS total, sum(CASE WHEN c THEN n ELSE 0 END)::BIGINT AS covered, round(sum(CASE WHEN c THEN n ELSE 0 END)::DOUBLE / sum(n), 9) AS pct FROM m GROUP BY s, a HAVING sum(CASE WHEN c THEN n ELSE 0 END)::DOUBLE / sum(n) < 0.5""")
def coverage_gaps(spark, d):
    items = tables.table(spark, d, "lineitem")
    a = F.col("l_partkey") % 50 * 20
    functions = items.select(F.col("l_suppkey").cast("string").alias("path"), F.concat(F.lit("f"), a).alias("function"), a.alias("start_line"), (a + 19).alias("end_line")).distinct()
    blocks = items.select(F.col("l_suppkey").cast("string").alias("file"), (F.col("l_orderkey") % 1000).alias("start_line"), F.col("l_linenumber").alias("num_stmt"), (F.col("l_quantity") > 25).alias("covered"))
    return reports.coverage_gaps(functions, blocks, 0.5).withColumn("pct", F.round("pct", 9))


@query("""WITH f AS (SELECT o_orderkey::VARCHAR AS path, o_orderpriority AS function, o_custkey % 40 AS complexity, o_orderkey % 100 AS start_line, o_orderkey % 100 + o_custkey % 7 - 2 AS end_line FROM orders)
    SELECT path, function, complexity, start_line, end_line, greatest(end_line - start_line + 1, 0) AS lines FROM f ORDER BY complexity DESC, path, start_line LIMIT 50""")
def complexity_report(spark, d):
    rows = tables.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderpriority").alias("function"), (F.col("o_custkey") % 40).alias("complexity"), (F.col("o_orderkey") % 100).alias("start_line"), (F.col("o_orderkey") % 100 + F.col("o_custkey") % 7 - 2).alias("end_line"))
    return reports.complexity(rows)


@query("""WITH n AS (SELECT o_custkey AS symbol, max(o_orderkey % 31) AS value FROM orders GROUP BY 1), b AS (SELECT o_custkey AS symbol, max(o_orderkey % 29) AS before FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT symbol, value, before, CASE WHEN value > 15 AND value > coalesce(before, 0) THEN 'fail' WHEN value > 15 THEN 'warn' ELSE 'pass' END AS verdict FROM n LEFT JOIN b USING (symbol)""")
def review_verdicts(spark, d):
    o = tables.table(spark, d, "orders")
    now = o.select(F.lit("x").alias("path"), F.col("o_custkey").alias("symbol"), (F.col("o_orderkey") % 31).alias("value"))
    base = o.where("o_orderstatus = 'F'").select(F.lit("x").alias("path"), F.col("o_custkey").alias("symbol"), (F.col("o_orderkey") % 29).alias("value"))
    return reports.review(now, base).drop("path")


def _links(spark, d):
    return tables.page_links(tables.table(spark, d, "pages"))


def _imports(spark, d):
    return _links(spark, d).select(F.col("url").alias("path"), F.lit("html").alias("language"), F.col("target").alias("module"))


@query(f"WITH {LINKS} SELECT target AS module, count(DISTINCT url) AS importers FROM links GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def graph_import_hubs(spark, d):
    return graph.import_hubs(_imports(spark, d))


@query(f"WITH {LINKS} SELECT url AS path, count(DISTINCT target) AS modules FROM links GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def graph_fan_out(spark, d):
    return graph.fan_out(_imports(spark, d))


@query(f"WITH {LINKS} SELECT DISTINCT url AS path, 'html' AS language FROM links WHERE starts_with(target, '/th')")
def graph_imported_by(spark, d):
    return graph.imported_by(_imports(spark, d), "/th", "prefix")


@query(f"WITH {LINKS} SELECT page_id::VARCHAR AS path, url AS symbol, 'page' AS kind FROM pages WHERE url NOT IN (SELECT target FROM links)")
def graph_dead_code(spark, d):
    defs = tables.table(spark, d, "pages").select(F.col("url").alias("symbol"), F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language"), F.lit("").alias("owner"), F.lit(True).alias("exported"))
    refs = _links(spark, d).select(F.col("target").alias("symbol"))
    return graph.dead_code(defs, refs, ["html"]).select("path", "symbol", "kind")


def _site_edges(spark, d):
    """A call graph of customers by arithmetic: a half and a third of each number call it."""
    c = tables.table(spark, d, "customer")
    return c.select(F.explode(F.array(F.expr("c_custkey div 2"), F.expr("c_custkey div 3"))).alias("src"), F.col("c_custkey").alias("dst")).where("src <> dst").distinct()


_EDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT unnest([c_custkey // 2, c_custkey // 3]) AS src, c_custkey AS dst FROM customer) WHERE src <> dst)"""


@query(f"""WITH {_EDGES}, o AS (SELECT src AS node, count(*) AS ce FROM edges GROUP BY 1), i AS (SELECT dst AS node, count(*) AS ca FROM edges GROUP BY 1)
    SELECT node, coalesce(ca, 0)::BIGINT AS ca, coalesce(ce, 0)::BIGINT AS ce, round(coalesce(ce, 0)::DOUBLE / (coalesce(ca, 0) + coalesce(ce, 0)), 9) AS instability FROM o FULL JOIN i USING (node)""")
def graph_coupling(spark, d):
    return graph.coupling(_site_edges(spark, d)).withColumn("instability", F.round("instability", 9))


_CHAIN = """e AS (SELECT DISTINCT 'c' || o_custkey AS caller, 'c' || (o_custkey // 3) AS callee FROM orders WHERE o_custkey // 3 > 0)"""


def _calls(spark, d):
    o = tables.table(spark, d, "orders").where("o_custkey div 3 > 0")
    return o.select(F.concat(F.lit("c"), "o_custkey").alias("caller"), F.expr("concat('c', o_custkey div 3)").alias("callee"))


@query(f"""WITH RECURSIVE {_CHAIN}, r AS (SELECT 'c2' AS symbol, 0 AS depth UNION ALL SELECT e.caller, r.depth + 1 FROM e JOIN r ON e.callee = r.symbol WHERE r.depth < 30)
    SELECT symbol, min(depth)::INT AS depth FROM r WHERE depth > 0 GROUP BY 1""")
def graph_impact(spark, d):
    return graph.impact(_calls(spark, d), "c2")


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS symbol, ['1'] AS path, 0 AS depth UNION ALL SELECT dst, list_append(path, dst::VARCHAR), depth + 1 FROM edges JOIN r ON src = symbol WHERE depth < 8)
    SELECT array_to_string(path, ' > ') AS path FROM r WHERE symbol = 100 ORDER BY depth, r.path LIMIT 1""")
def graph_call_path(spark, d):
    edges = _site_edges(spark, d).select(F.col("src").cast("string").alias("caller"), F.col("dst").cast("string").alias("callee"))
    return graph.call_path(edges, "1", "100")


_CYCLE_EDGES = """e AS (SELECT DISTINCT src, dst FROM (SELECT c_custkey AS src, unnest([CASE WHEN c_custkey % 5 = 4 THEN c_custkey - 4 ELSE c_custkey + 1 END, c_custkey // 2]) AS dst FROM customer) WHERE src <> dst)"""


def _cyclic(spark, d):
    c = tables.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("src"), F.explode(F.array(F.expr("CASE WHEN c_custkey % 5 = 4 THEN c_custkey - 4 ELSE c_custkey + 1 END"), F.expr("c_custkey div 2"))).alias("dst"))


@query(f"""WITH RECURSIVE {_CYCLE_EDGES}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
    m AS (SELECT x.a AS node, x.b AS peer FROM r x JOIN r y ON x.a = y.b AND x.b = y.a), g AS (SELECT node, least(node, min(peer)) AS component FROM m WHERE node <> peer GROUP BY 1)
    SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM g""")
def graph_cycles(spark, d):
    return graph.cycles(_cyclic(spark, d))


@query("""WITH u AS (SELECT l_partkey AS symbol, count(DISTINCT (l_partkey + l_linenumber // 7) % 5) AS n, min((l_partkey + l_linenumber // 7) % 5) AS f FROM lineitem GROUP BY 1)
    SELECT p_partkey::VARCHAR AS symbol, 'function' AS kind, 'd' || (p_partkey % 5) || '/x' AS path, 'd' || (p_partkey % 5) AS package FROM part JOIN u ON symbol = p_partkey WHERE n = 1 AND f = p_partkey % 5""")
def graph_unused_exports(spark, d):
    folder = lambda c: F.concat(F.lit("d"), F.expr(c) % 5, F.lit("/x"))
    defs = tables.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.lit("function").alias("kind"), folder("p_partkey").alias("path"), F.lit("go").alias("language"), F.lit(True).alias("exported"))
    refs = tables.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol"), folder("l_partkey + l_linenumber div 7").alias("path"), F.lit("go").alias("language"))
    return graph.unused_exports(defs, refs)


@query("""WITH t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 23 = 0), v AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 29 = 0),
    o AS (SELECT 'p' || (p_partkey % 50) AS path, p_partkey, p_partkey NOT IN (SELECT l_partkey FROM t) AS gap FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM v))
    SELECT path, count(*) AS total, count(*) FILTER (WHERE gap) AS untested, array_to_string(list_sort(list('f' || p_partkey) FILTER (WHERE gap)), ',') AS untested_functions FROM o GROUP BY 1 HAVING count(*) FILTER (WHERE gap) > 0""")
def graph_test_gaps(spark, d):
    name = lambda c: F.concat(F.lit("f"), F.col(c))
    defs = tables.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey") % 50).alias("path"), name("p_partkey").alias("symbol"), F.lit("function").alias("kind"), F.lit("go").alias("language"))
    items = tables.table(spark, d, "lineitem")
    refs = items.select(name("l_partkey").alias("symbol"), F.when(F.col("l_orderkey") % 23 == 0, "test/a").otherwise("b").alias("path"))
    passed_on = items.where("l_orderkey % 29 = 0").select(F.lit("value").alias("kind"), name("l_partkey").alias("symbol"))
    return graph.test_gaps(defs, refs, F.col("path").startswith("test/"), passed_on).withColumn("untested_functions", F.array_join("untested_functions", ","))


@query("""WITH a AS (SELECT DISTINCT p_brand AS name, p_size::VARCHAR AS kind FROM part WHERE p_size <= 30), b AS (SELECT DISTINCT p_brand AS name, p_size::VARCHAR AS kind FROM part WHERE p_size > 20)
    SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def api_diff(spark, d):
    p = tables.table(spark, d, "part").select("p_size", F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("kind"))
    return stats.api_diff(p.where("p_size <= 30"), p.where("p_size > 20"))


@query(f"""WITH {FILES}, p AS (SELECT * FROM (VALUES ('docs', 'root'), ('docs/src3', 'three'), ('docs/src1/de', 'one')) t(root, kind))
    SELECT doc_id, arg_max(root, length(root)) AS project_root, arg_max(kind, length(root)) AS project_type FROM files JOIN p ON dir = root OR starts_with(dir, root || '/') GROUP BY 1""")
def project_resolution(spark, d):
    projects = spark.createDataFrame([("docs", "root"), ("docs/src3", "three"), ("docs/src1/de", "one")], "root string, project_type string")
    return stats.nearest_project(docs(spark, d), projects).select("doc_id", "project_root", "project_type")


@query("""WITH s AS (SELECT *, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 21600000, true) AS fresh FROM events),
    g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, count(*) AS events, arg_max(event_type, ts) AS op FROM g GROUP BY user_id, k""")
def watch_debounce(spark, d):
    events = tables.table(spark, d, "events").withColumnRenamed("event_type", "op")
    return watch.debounce(events, "user_id", "6 hours").select("user_id", "events", "op")


@query(f"""WITH {FILES}, c AS (SELECT path, body, unnest(range(0, greatest(ceil((length(body) - 1000) / 875.0)::INT, 0) + 1)) AS chunk_id FROM files WHERE length(body) > 0)
    SELECT path, chunk_id::INT AS chunk_id, (chunk_id * 875)::INT AS start, substring(body, (chunk_id * 875 + 1)::INT, 1000) AS text FROM c""")
def overlapping_chunks(spark, d):
    return lines.chunks(docs(spark, d), 1000)


_U64 = "18446744073709551616"
#: The fingerprints of near_duplicates in SQL: FNV-1a over bytes by a fold, then a vote for each bit.
PRINTS = rf"""w AS (SELECT path, size, list_filter(string_split_regex(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2) AS w FROM files),
    g AS (SELECT path, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
    u AS (SELECT s, list_reduce(list_transform(range(1, strlen(s) * 2, 2), lambda i: ('0x' || hex(encode(s))[i:i + 1])::UBIGINT),
        lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211) % {_U64})::UBIGINT, 14695981039346656037::UBIGINT) AS h FROM (SELECT DISTINCT s FROM g)),
    v AS (SELECT path, ({" + ".join(f"(CASE WHEN sum((h >> {i}) & 1) * 2 > count(*) THEN {1 << i}::UHUGEINT ELSE 0 END)" for i in range(64))}) AS p FROM g JOIN u USING (s) GROUP BY path),
    prints AS (SELECT path, size, p::UBIGINT AS p FROM v JOIN w USING (path) WHERE p <> 0)"""


@query(f"""WITH RECURSIVE {FILES}, {PRINTS}, c AS (SELECT p, count(*) AS n FROM prints GROUP BY p),
    e AS (SELECT x.p AS a, y.p AS b FROM c x JOIN c y ON bit_count(xor(x.p, y.p)) <= 9),
    r AS (SELECT p AS a, p AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    k AS (SELECT a AS p, min(b) AS root FROM r GROUP BY 1), m AS (SELECT path, size, p, root FROM prints JOIN k USING (p)),
    t AS (SELECT root, count(*) AS members, arg_min(path, (-size, path)) AS top, arg_min(p, (-size, path)) AS tp FROM m GROUP BY root HAVING count(*) > 1)
    SELECT top AS "group", path, size, 1 - bit_count(xor(p, tp)) / 64.0::DOUBLE AS similarity, path = top AS is_representative, members FROM m JOIN t USING (root)""")
def near_duplicate_files(spark, d):
    return near_duplicates.near_duplicates(docs(spark, d))


@query(f"""WITH {FILES}, {PRINTS} SELECT path, size, (CASE WHEN p >= 9223372036854775808 THEN p::HUGEINT - {_U64} ELSE p::HUGEINT END)::BIGINT AS print FROM prints""")
def simhash_fingerprints(spark, d):
    return near_duplicates.fingerprints(docs(spark, d))


@query(f"""WITH {FILES}, l AS (SELECT doc_id, {LINES} AS ls FROM files)
    SELECT doc_id, len(list_filter(ls, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#')))::BIGINT AS loc,
    len(list_filter(ls, lambda x: starts_with(trim(x), '#')))::BIGINT AS comment_loc, len(list_filter(ls, lambda x: trim(x) = ''))::BIGINT AS blank_loc FROM l""")
def line_roles(spark, d):
    return lines.loc(docs(spark, d).withColumn("language", F.lit("python"))).select("doc_id", "loc", "comment_loc", "blank_loc")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from quarry.plans import file_catalog  # noqa: E402, F401  registers the queries over file rows here
