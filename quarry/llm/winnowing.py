"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a row of tokens: its words, but single characters where a script puts
no blanks between words or a run without blanks is very long.  A rolling hash
gives every run of K tokens a number; of every window of W numbers in a row the
least is kept, of equals the rightmost, with its position (the number of its
first token).  Two texts that share K + W - 1 tokens in a row share a kept hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.runtime import shuffle_partitions

K = 5
W = 4
#: A text of fewer characters than this also keeps all its runs of SHORT_RUN characters.
SHORT, SHORT_RUN = 64, 3
#: A run without blanks of more characters than this counts as its characters.
LONG_WORD = 32
#: Rows of a task where texts meet their neighbours, on average; tasks at most; ranges a task.
TASK_ROWS, TASKS, RANGES = 20_000, 10_000, 4
# The rolling hash: numbers below a prime, a base, and tokens that are rolled over at a time.
_PRIME, _BASE, _STRETCH = (1 << 31) - 1, 1_103_515_245, 16
_LOW = 0xFFFFFFFF
_NO_ID = -(1 << 63)
_BLANK = "[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]"
# Blocks of scripts without blanks between words: Thai to Tibetan, Myanmar, Khmer, kana, Han and its supplements.
_UNSPACED = "([\\\\x{0E00}-\\\\x{0FFF}\\\\x{1000}-\\\\x{109F}\\\\x{1780}-\\\\x{17FF}\\\\x{3040}-\\\\x{30FF}\\\\x{3400}-\\\\x{4DBF}\\\\x{4E00}-\\\\x{9FFF}\\\\x{F900}-\\\\x{FAFF}\\\\x{20000}-\\\\x{3FFFF}])"


def _let(value: str, name: str, body: str) -> str:
    """*body* with *name* bound to *value*, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def tokens_sql(text: str) -> str:
    """SQL for the tokens of *text*: words between ASCII white space, or single characters (see LONG_WORD)."""
    spaced = f"if(octet_length({text}) > char_length({text}) and {text} rlike '{_UNSPACED}', regexp_replace({text}, '{_UNSPACED}', ' $1 '), {text})"
    characters = "transform(sequence(1, char_length(x)), c -> substring(x, c, 1))"
    single = f"flatten(transform(plain, x -> if(char_length(x) > {LONG_WORD}, {characters}, array(x))))"
    return _let(f"array_remove(split({spaced}, '{_BLANK}+'), '')", "plain", f"if(exists(plain, x -> octet_length(x) > {LONG_WORD}), {single}, plain)")


def _runs(k: int) -> str:
    """SQL for the hash of each run of *k* of the token numbers ``nums``; of fewer tokens, of all of them.

    With prefixes p(i) = p(i - 1) * BASE + number, the hash of the run that ends at
    i is p(i) - p(i - k) * BASE^k: a multiplication and a subtraction a run, for
    any k.  Prefixes start anew after _STRETCH runs, so that none of them is long.
    """
    prefixes = lambda nums: f"aggregate({nums}, array(0L), (p, x) -> array_append(p, (element_at(p, -1) * {_BASE} + x) % {_PRIME}))"
    rolled = f"transform(sequence({k}, size(p) - 1), i -> pmod(get(p, i) - get(p, i - {k}) * {pow(_BASE, k, _PRIME)}L, {_PRIME}))"
    stretch = _let(prefixes(f"slice(nums, at + 1, {_STRETCH + k - 1})"), "p", rolled)
    return f"if(size(nums) < {k}, array(element_at({prefixes('nums')}, -1)), flatten(transform(sequence(0, greatest(size(nums) - {k}, 0), {_STRETCH}), at -> {stretch})))"


def winnow_sql(text: str, k: int = K, w: int = W) -> str:
    """SQL for the kept hashes of *text* in the order of their positions, as array<bigint>.

    The upper half of each number is a run's hash, the lower half 2^32 - 1 less
    its position: so the least of a window is its least hash, of equals the
    rightmost.  A text of fewer than *k* tokens is one run, one of fewer than *w*
    runs one window.  A text of fewer than SHORT characters has its runs of
    SHORT_RUN characters behind these, so that an edit does not change all of it;
    their positions are told apart by 2^31.  A null or empty text has none.
    """
    marked = f"zip_with(runs, sequence({_LOW}L, {_LOW + 1}L - size(runs), -1L), (h, p) -> shiftleft(h, 32) | p)"
    least = f"least({', '.join(f'get(marks, i + {j})' for j in range(w))})" if w > 1 else "get(marks, i)"
    kept = f"array_distinct(transform(sequence(0, greatest(size(marks) - {w}, 0)), i -> {least}))"
    none = "cast(array() as array<bigint>)"
    of_tokens = _let(f"transform(tokens, x -> pmod(xxhash64(x), {_PRIME}))", "nums", _let(_runs(k), "runs", _let(marked, "marks", kept)))
    gram = f"shiftleft(pmod(xxhash64('short', substring({text}, i + 1, {SHORT_RUN})), {_PRIME}), 32) | ({_LOW}L - 2147483648L - i)"
    grams = f"transform(sequence(0, greatest(char_length({text}) - {SHORT_RUN}, 0)), i -> {gram})"
    some = f"if(size(tokens) = 0, {none}, if(char_length({text}) < {SHORT}, concat({of_tokens}, {grams}), {of_tokens}))"
    return f"if({text} is null, {none}, {_let(tokens_sql(text), 'tokens', some)})"


def hashes(kept: str) -> str:
    """SQL for the hashes alone (array<int>), one for each kept run."""
    return f"transform({kept}, v -> cast(shiftright(v, 32) as int))"


def positions(kept: str) -> str:
    """SQL for the positions of the kept runs (array<int>): the first token, or -1 less the first character for a run of characters."""
    return f"transform({kept}, v -> cast(if({_LOW}L - (v & {_LOW}L) < 2147483648L, {_LOW}L - (v & {_LOW}L), (v & {_LOW}L) - 2147483648L) as int))"


def likeness(a: str, b: str) -> str:
    """SQL for the Jaccard likeness of two hash arrays as sets; 1 if both are empty."""
    return f"if(size({a}) + size({b}) = 0, 1.0D, cast(size(array_intersect({a}, {b})) as double) / size(array_union({a}, {b})))"


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hashes, positions) of every row's whole text; a null or blank text has empty arrays.

    positions[i] is where the kept run of hashes[i] begins (see positions); a hash
    that is kept at several places is there for each.  Repeated rows give a row
    each, an empty table none; other columns are not read.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", F.expr(winnow_sql("text", k, w)).alias("kept"))
    return kept.select("doc_id", F.expr(hashes("kept")).alias("hashes"), F.expr(positions("kept")).alias("positions"))


def _longs(values) -> str:
    return "array(" + ",".join(f"{v}L" if v > _NO_ID else "-9223372036854775807L - 1L" for v in values) + ")"


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are below *key*, found in two steps so that thousands of cuts stay cheap."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse, fine = F.expr(_longs(b[-1] for b in blocks)), F.expr("array(" + ",".join(_longs(b) for b in blocks) + ")")

    def within(v: Column, b: Column) -> Column:
        return F.least(b * step, F.lit(len(cuts))) + F.coalesce(F.size(F.filter(F.get(fine, b), lambda c: c < v)), F.lit(0))

    return F.transform(F.array(key), lambda v: F.transform(F.array(F.size(F.filter(coarse, lambda c: c < v))), lambda b: within(v, b))[0])[0]


def dealt_by_key(rows: DataFrame, key: str, then: list[str]) -> DataFrame:
    """*rows* in ranges of falling *key* (a bigint without nulls), equal keys by *then*: each range is sorted in one task.

    Adds ``__part`` (range), ``__guest``: the first row of a range is also there
    at the end of the range before it (of the first, at the end of the last),
    with __guest = 1.  So every row's follower is the next one of its range.
    Ranges have about equal numbers of rows and are RANGES times as many as
    tasks, so that tasks stay even; rows move once.
    """
    ids = rows.select(F.col(key).alias("id"))
    tasks = min(TASKS, max(shuffle_partitions(rows.sparkSession), -(-ids.count() // TASK_ROWS)))
    n = tasks * RANGES
    cuts = sorted(set(ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0] or [])) if n > 1 else []
    heads = {r.part: r.head for r in ids.groupBy(_range_of(F.col("id"), cuts).alias("part")).agg(F.max("id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    # of each range: its first key, and the range before it in falling order; before the first comes the last
    before = {p: order[i - 1] for i, p in enumerate(order)}
    head, host = F.expr(_longs(heads.get(p, 0) for p in range(len(cuts) + 1))), F.expr(_longs(before.get(p, 0) for p in range(len(cuts) + 1)))
    dealt = rows.withColumn("__part", _range_of(F.col(key), cuts))
    own = F.struct(F.col("__part").alias("part"), F.lit(0).alias("guest"))
    guest = F.when(F.get(head, F.col("__part")) == F.col(key), F.struct(F.get(host, F.col("__part")).cast("int").alias("part"), F.lit(1).alias("guest")))
    dealt = dealt.withColumn("__to", F.explode(F.array_compact(F.array(own, guest)))).drop("__part")
    dealt = dealt.select(*rows.columns, F.col("__to.part").alias("__part"), F.col("__to.guest").alias("__guest"))
    return dealt.repartition(tasks, "__part").sortWithinPartitions("__part", "__guest", F.col(key).desc(), *then)


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """One row per row of *docs*: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions, edited_positions.

    The edited text is the whole text with its last floor(n_chars / 3) code
    points replaced by the first as many (or all) of the next document, by
    falling doc_id, after the last the first.  Rows of equal doc_id follow each
    other by text, null ids come last; a row alone is its own next.  A fingerprint
    is the list of kept hashes in the order of their positions, blank for a text
    without words, and positions says where each of them begins.  A null text is
    empty; an empty table gives no rows; other columns are not read.

    Only ids and texts move, once; hashes are worked out where neighbours meet.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("key"), text.alias("text"))
    met = dealt_by_key(rows, "key", ["text"]).withColumn("kept", F.expr(winnow_sql("text", k, w)))
    follows = F.lead(F.struct("text", "kept")).over(Window.partitionBy("__part").orderBy("__guest", F.col("key").desc(), "text"))
    met = met.withColumn("next", follows).where("__guest = 0")
    cut = "cast(floor(char_length(text) / 3) as int)"
    met = met.withColumn("edited", F.expr(f"concat(substring(text, 1, char_length(text) - {cut}), substring(next.text, 1, {cut}))"))
    met = met.withColumn("changed", F.expr(winnow_sql("edited", k, w)))
    line = lambda a: f"array_join(cast({a} as array<string>), ' ')"
    near = lambda a, b: _let(hashes(a), "a", _let(hashes(b), "b", likeness("a", "b")))
    return met.selectExpr(
        "doc_id",
        "cast(char_length(text) as bigint) AS n_chars",
        "sha2(cast(edited as binary), 256) AS edited_sha256",
        f"{line(hashes('kept'))} AS fingerprint",
        f"{line(hashes('changed'))} AS edited_fingerprint",
        f"{near('kept', 'changed')} AS near_edited",
        f"{near('kept', 'next.kept')} AS near_next",
        f"{line(positions('kept'))} AS positions",
        f"{line(positions('changed'))} AS edited_positions",
    )
