"""The registered queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import re

import public_tokenizers
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, language_id, licenses, mixing, packing, quality, simhash_dedup, token_counts, toxicity, winnowing, words

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "mix.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = words.remainder("doc_id", 3) == 1
    model = language_id.fit(docs.where(~held_out))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = words.remainder("doc_id", 5) == 4
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    found = quality.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "expected_grade", "tail_probability", "selected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = words.remainder("doc_id", 4) == 2
    languages = language_id.fit(docs.where(~held_out))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out), languages=languages)
    found = toxicity.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " AND ").alias("licenses"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = (
    op1_document_fingerprints,
    op2_source_mixing,
    op3_language_id,
    op4_simhash_near_dedup,
    op5_quality_classifier,
    op6_toxicity,
    op7_exact_dedup,
    op8_best_fit_packing,
    op9_license_scan,
    op10_token_counts,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _license_sql() -> str:
    """Sentences by lines and marks, their identifiers by a join, then the rules one after another on what is left."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = {re.sub(licenses._UNDER, "licensed under ", k): v for k, v in licenses.SENTENCES.items()}
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in table.items())
    rules = ", ".join(f"({n}, {quote(name)}, [{', '.join(map(quote, ids))}])" for n, (name, ids) in enumerate(licenses.RULES, 1))
    telling = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in licenses.TELLING.items())
    ways = "(?:licensed|released|distributed|published|provided|available|made available) under "
    gnu = "you can redistribute it and or modify it under the terms of the "
    things = "(?:this|the|these|our|your)?(?: ?source)? ?(?:code|work|software|file|files|program|project|library|package|document|documentation|text|content|module|site)? ?(?:is|are)(?: also)? "
    normal = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), '\\blicence', 'license', 'g'),
        '^(?:.*\\b(?:is|are)(?: also| dual)? ({ways})|.* ({gnu}))', '\\1\\2'),
        '^(?:copyright(?: c)?(?: [0-9]+)?(?: [a-z0-9]+){{0,8}}? (all rights reserved)$|{things})', '\\1'),
        '^{ways}(?:the terms of (?:the )?)?(?:the |an? )?', 'licensed under '), '^(licensed under .*?) see .*$', '\\1')"""
    parts = lambda x: f"string_split_regex(replace(regexp_replace(regexp_replace({x}, '([Ii]dentifier):', '\\1' || chr(1), 'g'), '([.!?;:])\\s+', '\\1' || chr(10), 'g'), chr(1), ':'), '\\s*\\n\\s*')"
    return f"""
        WITH RECURSIVE known(s, id) AS (VALUES {known}), rule(r, name, need) AS (VALUES {rules}), telling(id, name) AS (VALUES {telling}),
        l AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        j AS (SELECT doc_id, t, ls, list_transform(ls, lambda x, i: i > 1 AND regexp_matches(ls[i - 1], '[^.!?;:\\s][ \\t]*\\r?$') AND NOT (i < len(ls) AND regexp_matches(x, '^[ \\t]*\\r?$'))) AS tied FROM l),
        u AS (SELECT doc_id, t, array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = 1 THEN '' WHEN tied[i] THEN ' ' ELSE chr(10) END
            || regexp_replace(CASE WHEN tied[i] THEN regexp_replace(x, '^[ \\t#*/-]*', '') ELSE x END, CASE WHEN i < len(ls) AND tied[i + 1] THEN '[ \\t]*\\r?$' ELSE '$^' END, '')), '') AS w FROM j),
        p AS (SELECT doc_id, 1 AS pass, unnest({parts("w")}) AS s, generate_subscripts({parts("w")}, 1) AS k FROM u UNION ALL SELECT doc_id, 2, unnest({parts("t")}), generate_subscripts({parts("t")}, 1) FROM u),
        n AS (SELECT doc_id, pass, k, {normal} AS s FROM p WHERE regexp_matches(s, {quote(licenses.TRIGGER)})),
        i AS (SELECT doc_id, pass, k, id FROM n JOIN known USING (s)),
        a AS (SELECT doc_id, list(id ORDER BY pass, k) AS ids FROM i WHERE pass = 1 OR NOT EXISTS (SELECT 1 FROM i o WHERE o.doc_id = i.doc_id AND o.pass = 1 AND o.id = i.id) GROUP BY doc_id),
        run AS (SELECT doc_id, 1 AS r, '' AS fixed, ' ' || array_to_string(ids, ' ') || ' ' AS rest, []::VARCHAR[] AS found FROM a
            UNION ALL
            SELECT doc_id, r + (met IS NULL)::INT, CASE WHEN met IS NULL THEN '' ELSE fixed || split_part(met, '|', 1) END, CASE WHEN met IS NULL THEN fixed || rest ELSE split_part(met, '|', 2) END, CASE WHEN met IS NULL THEN found ELSE list_append(found, name) END
            FROM (SELECT run.*, rule.name, list_reduce(list_prepend('|' || rest, need), lambda acc, x: CASE WHEN strpos(split_part(acc, '|', 2), ' ' || x || ' ') = 0 THEN NULL
                ELSE split_part(acc, '|', 1) || left(split_part(acc, '|', 2), strpos(split_part(acc, '|', 2), ' ' || x || ' ') - 1) || '|' || substr(split_part(acc, '|', 2), strpos(split_part(acc, '|', 2), ' ' || x || ' ') + length(x) + 1) END) AS met
                FROM run JOIN rule USING (r))),
        e AS (SELECT doc_id, fixed || rest AS rest, found FROM run WHERE r = (SELECT max(r) + 1 FROM rule)),
        f AS (SELECT doc_id, name, k FROM (SELECT doc_id, unnest(found) AS name, generate_subscripts(found, 1) AS k FROM e)
            UNION ALL SELECT doc_id, telling.name, 1000 + k FROM (SELECT doc_id, unnest(string_split(rest, ' ')) AS id, generate_subscripts(string_split(rest, ' '), 1) AS k FROM e) JOIN telling USING (id)),
        g AS (SELECT doc_id, string_agg(name, ' AND ' ORDER BY k) AS licenses FROM (SELECT doc_id, name, min(k) AS k FROM f GROUP BY ALL) GROUP BY doc_id)
        SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN g USING (doc_id)
    """


_M = 1 << 64
#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _xxh64_sql(name: str, source: str, seed: int) -> str:
    """Common tables that end in *name* (s, h): the XXH64 of every distinct s of *source*, by folds over its words, half word and bytes."""
    wrap = lambda x: f"(({x}) % {_M}::UHUGEINT)::UBIGINT"
    mul = lambda a, b: wrap(f"({a})::UHUGEINT * {b}::UHUGEINT")
    add = lambda a, b: wrap(f"({a})::UHUGEINT + {b}::UHUGEINT")
    rotl = lambda a, r: wrap(f"({a})::UHUGEINT * {1 << r} + (({a}) >> {64 - r})::UHUGEINT")
    turn = lambda acc, x: mul(rotl(wrap(f"({acc})::UHUGEINT + {mul(x, _P2)}::UHUGEINT"), 31), _P1)
    fold = lambda first, rest, step: f"list_reduce(list_prepend({first}, {rest}), lambda acc, x: {step})"
    pair = lambda o: f"b[2 * ({o}) + 1:2 * ({o}) + 2]"
    number = lambda o, n: f"('0x' || {' || '.join(pair(f'{o} + {k}') for k in reversed(range(n)))})::UBIGINT"
    begin = [(seed + _P1 + _P2) % _M, (seed + _P2) % _M, seed, (seed - _P1) % _M]
    lanes = ", ".join(fold(f"{v}::UBIGINT", f"list_transform(range(0, n // 32), lambda i: w[4 * i + {k + 1}])", turn("acc", "x")) + f" AS v{k}" for k, v in enumerate(begin))
    joined = "(" + " + ".join(f"{rotl(f'v{k}', r)}::UHUGEINT" for k, r in enumerate((1, 7, 12, 18))) + ")"
    merged = fold(wrap(joined), "[v0, v1, v2, v3]", add(mul(f"xor(acc, {turn('0::UBIGINT', 'x')})", _P1), _P4))
    words = fold("h", "w[4 * (n // 32) + 1:]", add(mul(rotl(f"xor(acc, {turn('0::UBIGINT', 'x')})", 27), _P1), _P4))
    half = f"CASE WHEN n % 8 >= 4 THEN {add(mul(rotl(f'xor(h, {mul(number('8 * (n // 8)', 4), _P1)})', 23), _P2), _P3)} ELSE h END"
    tail = f"list_transform(range(8 * (n // 8) + CASE WHEN n % 8 >= 4 THEN 4 ELSE 0 END, n), lambda i: {number('i', 1)})"
    last = fold("h", tail, mul(rotl(f"xor(acc, {mul('x', _P5)})", 11), _P1))
    x = f"{name}_"
    return f"""{x}0 AS (SELECT s, hex(encode(s)) AS b, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM {source})),
        {x}1 AS (SELECT *, list_transform(range(0, n // 8), lambda i: {number("8 * i", 8)}) AS w FROM {x}0),
        {x}2 AS (SELECT *, {lanes} FROM {x}1), {x}3 AS (SELECT s, b, n, w, {add(f"CASE WHEN n >= 32 THEN {merged} ELSE {(seed + _P5) % _M}::UBIGINT END", "n")} AS h FROM {x}2),
        {x}4 AS (SELECT s, b, n, {words} AS h FROM {x}3), {x}5 AS (SELECT s, b, n, {half} AS h FROM {x}4), {x}6 AS (SELECT s, {last} AS h FROM {x}5),
        {x}7 AS (SELECT s, {mul("xor(h, h >> 33)", _P2)} AS h FROM {x}6), {x}8 AS (SELECT s, {mul("xor(h, h >> 29)", _P3)} AS h FROM {x}7), {name} AS (SELECT s, xor(h, h >> 32) AS h FROM {x}8)"""


def _simhash_sql() -> str:
    """Shingles, a vote of their hashes for each bit, links and what they reach."""
    votes = " + ".join(f"(CASE WHEN sum((h >> {i}) & 1) * 2 > count(*) THEN {1 << i}::UHUGEINT ELSE 0 END)" for i in range(64))
    return f"""
        WITH RECURSIVE t AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT row, unnest(CASE WHEN len(ws) > 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [array_to_string(ws, ' ')] END) AS s FROM t WHERE len(ws) > 0),
        {_xxh64_sql("x", "g", 42)},
        v AS (SELECT row, ({votes})::UBIGINT AS p FROM g JOIN x USING (s) GROUP BY row),
        d AS (SELECT doc_id, coalesce(p, 0::UBIGINT) AS p FROM t LEFT JOIN v USING (row)),
        c AS (SELECT p, min(doc_id) AS class_id, count(*) AS class_size FROM d GROUP BY p),
        e AS (SELECT x.p AS a, y.p AS b FROM c x JOIN c y ON x.p <> y.p AND bit_count(xor(x.p, y.p)) <= 3),
        r AS (SELECT p AS a, p AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        k AS (SELECT a AS p, min(class_id) AS component_id FROM r JOIN c ON c.p = r.b GROUP BY a), m AS (SELECT a AS p, count(*) AS links FROM e GROUP BY a)
        SELECT doc_id, lpad(lower(hex(p)), 16, '0') AS fingerprint, component_id, class_id, class_size, coalesce(links, 0) AS links FROM d JOIN c USING (p) JOIN k USING (p) LEFT JOIN m USING (p)
    """


def _fingerprint_sql() -> str:
    """Tokens and their hashes, a polynomial over each run, the least of each window, and the runs of characters of short texts."""
    unspaced = "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in (("0E00", "0FFF"), ("1000", "109F"), ("1780", "17FF"), ("3040", "30FF"), ("3400", "4DBF"), ("4E00", "9FFF"), ("F900", "FAFF"), ("20000", "3FFFF")))
    number = lambda h: f"(((CASE WHEN {h} >= 9223372036854775808 THEN {h}::HUGEINT - {_M} ELSE {h}::HUGEINT END) % {winnowing._PRIME} + {winnowing._PRIME}) % {winnowing._PRIME})::BIGINT"
    run = lambda nums: f"list_reduce(list_prepend(0::BIGINT, {nums}), lambda acc, x: (acc * {winnowing._BASE} + x) % {winnowing._PRIME})"
    k, w, low = winnowing.K, winnowing.W, winnowing._LOW
    line = lambda column, field: f"array_to_string(list_transform({column}, lambda x: x.{field}), ' ')"
    own = lambda column: f"list_distinct(list_transform({column}, lambda x: x.h))"
    near = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({own(a)}, {own(b)}))::DOUBLE / len(list_distinct(list_concat({own(a)}, {own(b)}))) END"
    return f"""
        WITH o AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC, text) AS i FROM documents),
        n AS (SELECT a.*, b.text AS following, b.i AS j FROM o a JOIN o b ON b.i = a.i % (SELECT count(*) FROM o) + 1),
        q AS (SELECT *, left(text, length(text) - length(text) // 3) || left(following, length(text) // 3) AS edited FROM n),
        u AS (SELECT DISTINCT text FROM (SELECT text FROM q UNION ALL SELECT edited FROM q)),
        z AS (SELECT text, list_filter(string_split_regex(regexp_replace(text, '([{unspaced}])', ' \\1 ', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS plain FROM u),
        t AS (SELECT text, flatten(list_transform(plain, lambda x: CASE WHEN length(x) > {winnowing.LONG_WORD} THEN string_split(x, '') ELSE [x] END)) AS tokens FROM z),
        p AS (SELECT text, unnest(tokens) AS s, generate_subscripts(tokens, 1) AS i FROM t),
        {_xxh64_sql("x", "p", 42)},
        m AS (SELECT text, list({number("h")} ORDER BY i) AS nums FROM p JOIN x USING (s) GROUP BY text),
        r AS (SELECT text, CASE WHEN len(nums) < {k} THEN [{run("nums")}] ELSE list_transform(range(1, len(nums) - {k - 2}), lambda i: {run(f"nums[i:i + {k - 1}]")}) END AS runs FROM m),
        s AS (SELECT text, list_transform(runs, lambda h, i: h * {low + 1} + {low} - (i - 1)) AS marks FROM r),
        k AS (SELECT text, list_sort(list_distinct(list_transform(range(1, greatest(len(marks) - {w - 1}, 1) + 1), lambda i: {{'p': {low} - list_min(marks[i:i + {w - 1}]) % {low + 1}, 'h': list_min(marks[i:i + {w - 1}]) // {low + 1}}}))) AS kept FROM s),
        c AS (SELECT text, substring(text, i + 1, {winnowing.SHORT_RUN}) AS s, i FROM (SELECT text, unnest(range(0, greatest(length(text) - {winnowing.SHORT_RUN}, 0) + 1)) AS i FROM m WHERE length(text) < {winnowing.SHORT})),
        {_xxh64_sql("y", "c", xxhash.xxh64_intdigest(b"short", 42))},
        f AS (SELECT text, list({{'p': -1 - i, 'h': {number("h")}}} ORDER BY i) AS grams FROM c JOIN y USING (s) GROUP BY text),
        a AS (SELECT text, coalesce(list_concat(kept, coalesce(grams, [])), []) AS kept FROM u LEFT JOIN k USING (text) LEFT JOIN f USING (text))
        SELECT q.doc_id, length(q.text) AS n_chars, sha256(q.edited) AS edited_sha256, {line("o.kept", "h")} AS fingerprint, {line("e.kept", "h")} AS edited_fingerprint,
            {near("o.kept", "e.kept")} AS near_edited, {near("o.kept", "n.kept")} AS near_next, {line("o.kept", "p")} AS positions, {line("e.kept", "p")} AS edited_positions
        FROM q JOIN a o ON o.text = q.text JOIN a e ON e.text = q.edited JOIN a n ON n.text = q.following
    """


SQL = {
    "op1_document_fingerprints": _fingerprint_sql(),
    "op4_simhash_near_dedup": _simhash_sql(),
    "op9_license_scan": _license_sql(),
    # shares by largest remainders; then earliest deadline first, slot by slot, with weights that start anew when a source runs out
    "op2_source_mixing": """
        WITH RECURSIVE c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM documents GROUP BY source),
        e AS (SELECT *, sqrt(n::DOUBLE) * greatest(1000, 8 * count(*) OVER ()) / sum(sqrt(n::DOUBLE)) OVER () AS exact, greatest(1000, 8 * count(*) OVER ()) AS slots FROM c),
        f AS (SELECT *, greatest(1, floor(exact)::BIGINT) AS low FROM e),
        w AS (SELECT *, low + (row_number() OVER (ORDER BY floor(exact) - exact, i) <= slots - sum(low) OVER ())::BIGINT AS share FROM f),
        l AS (SELECT list(share ORDER BY i) AS share, list((n + 15) // 16 ORDER BY i) AS blocks FROM w),
        run AS (
            SELECT 0::BIGINT AS t, 0::BIGINT AS base, 0 AS phase, list_transform(blocks, lambda x: 0::BIGINT) AS done, blocks AS remaining, NULL::BIGINT AS i, NULL::BIGINT AS release, NULL::BIGINT AS deadline, NULL::INT AS own FROM l
            UNION ALL
            SELECT t + 1, CASE WHEN remaining[pick] = 1 THEN t + 1 ELSE base END, phase + (remaining[pick] = 1)::INT,
                list_transform(done, lambda x, k: CASE WHEN remaining[pick] = 1 THEN 0 WHEN k = pick THEN x + 1 ELSE x END),
                list_transform(remaining, lambda x, k: CASE WHEN k = pick THEN x - 1 ELSE x END),
                pick, base + done[pick] * total // share[pick], base + ((done[pick] + 1) * total + share[pick] - 1) // share[pick], phase
            FROM (SELECT r.*, l.share, total, list_sort(list_transform(list_filter(range(1, len(r.remaining) + 1), lambda k: r.remaining[k] > 0 AND r.done[k] * total // l.share[k] <= r.t - r.base),
                    lambda k: {'due': ((r.done[k] + 1) * total + l.share[k] - 1) // l.share[k], 'k': k}))[1].k AS pick
                FROM (SELECT run.*, (SELECT sum(x.share)::BIGINT FROM w x WHERE run.remaining[x.i] > 0) AS total FROM run) r, l WHERE list_sum(r.remaining) > 0)),
        b AS (SELECT i, t - 1 AS slot, release, deadline, own AS phase, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS block FROM run WHERE i IS NOT NULL),
        d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 4096, doc_id) - 1 AS index FROM documents)
        SELECT doc_id, d.source, share / (SELECT sum(share) FROM w)::DOUBLE AS target_weight, phase, block, release, deadline, slot,
            row_number() OVER (ORDER BY slot, index) - 1 AS position
        FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN b ON b.i = w.i AND b.block = d.index // 16
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
