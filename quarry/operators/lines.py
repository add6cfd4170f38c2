"""Line search with context, line ranges, and comment or code roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.plans.cel import re2

# The comment marks of languages: line mark, block begin, block end.
COMMENTS = {
    "go javascript typescript rust c cpp java swift kotlin scala csharp php": ("//", "/*", "*/"),
    "zig": ("//", "", ""),
    "python shell elixir perl r yaml toml": ("#", "", ""),
    "ruby": ("#", "=begin", "=end"),
    "lua": ("--", "--[[", "]]"),
    "haskell": ("--", "{-", "-}"),
    "ocaml": ("", "(*", "*)"),
    "clojure assembly": (";", "", ""),
    "ada": ("--", "", ""),
    "sql": ("--", "/*", "*/"),
    "vb": ("'", "", ""),
    "fortran": ("!", "", ""),
    "matlab": ("%", "%{", "%}"),
    "pascal": ("//", "{", "}"),
    "html xml markdown": ("", "<!--", "-->"),
}
#: Lines that are folded at a time.
_STRETCH = 256
MARKS = {language: marks for languages, marks in COMMENTS.items() for language in languages.split()}


def _roles(lines: Column, language: str) -> Column:
    """'comment', 'code' or 'blank' for each line, by what it begins with; an open block goes on over lines."""
    line_mark, begin, end = MARKS.get(language, ("", "", ""))

    def role_of(state: Column, line: Column) -> tuple[Column, Column]:
        bare = F.trim(line)
        opens = bare.startswith(begin) if begin else F.lit(False)
        closes = bare.contains(end) if end else F.lit(False)
        closes_after = F.locate(end, bare, len(begin) + 1) > 0 if begin and end else F.lit(False)
        comment = state["open"] | opens | (bare.startswith(line_mark) if line_mark else F.lit(False))
        still = F.when(state["open"], ~closes).otherwise(opens & ~closes_after)
        role = F.when((bare == "") & ~state["open"], "blank").when(comment, "comment").otherwise("code")
        return still, role

    if not end:
        return F.transform(lines, lambda x: role_of(F.struct(F.lit(False).alias("open")), x)[1])

    # lines are folded in stretches, so that no array grows line by line over the whole file
    def one(state: Column, line: Column) -> Column:
        still, role = role_of(state, line)
        return F.struct(still.alias("open"), F.array_append(state["roles"], role).alias("roles"))

    none = F.array().cast("array<string>")

    def stretch(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state["open"].alias("open"), none.alias("roles")), one)
        return F.transform(F.array(done), lambda d: F.struct(d["open"].alias("open"), F.concat(state["roles"], d["roles"]).alias("roles")))[0]

    at = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(_STRETCH))
    parts = F.transform(at, lambda i: F.slice(lines, i + 1, F.lit(_STRETCH)))
    return F.aggregate(parts, F.struct(F.lit(False).alias("open"), none.alias("roles")), stretch, lambda s: s["roles"])


def roles(lines: Column, language: Column) -> Column:
    """Line roles by language; of a language without comment marks all lines are code."""


    def of(lines: Column) -> Column:
        out = None
        for languages, _ in COMMENTS.items():
            test = F.lower(language).isin(languages.split())
            own = _roles(lines, languages.split()[0])
            out = F.when(test, own) if out is None else out.when(test, own)
        return out.otherwise(F.transform(lines, lambda x: F.when(F.trim(x) == "", "blank").otherwise("code")))

    return F.transform(F.array(lines), of)[0]


def loc(files: DataFrame) -> DataFrame:
    """*files* with loc, comment_loc and blank_loc of body by language."""
    found = files.withColumn("__r", roles(text.lines(F.col("body")), F.col("language")))
    count = lambda role: F.size(F.filter("__r", lambda x: x == role)).cast("bigint")
    return found.withColumns({"loc": count("code"), "comment_loc": count("comment"), "blank_loc": count("blank")}).drop("__r")


def find_matches(files: DataFrame, pattern: str, *, before: int = 0, after: int = 0, per_file: int | None = None, role: str = "any") -> DataFrame:
    """(path, line, text, before, after) of every line that matches, in the order of path and line.

    A file's lines stay together in one array while its hits take their context
    from it: there is no window over lines and no shuffle but the final order.  *per_file* caps
    the hits of a file; *role* keeps comments or code only.
    """
    tests = F.lit(re2(pattern))
    language = F.col("language") if "language" in files.columns else F.lit("")

    def hits(ls: Column, kinds: Column | None) -> Column:
        """Each hit with its context: what is exploded holds a few lines, never the file's."""
        wanted = None if kinds is None else {"comments": "comment", "code": "code"}[role]
        at = F.array_compact(F.transform(ls, lambda x, i: F.when(F.rlike(x, tests) if kinds is None else F.rlike(x, tests) & (F.get(kinds, i) == wanted), i)))
        if per_file is not None:
            at = F.slice(at, 1, per_file)
        low = lambda i: F.greatest(i - before, F.lit(0))
        return F.transform(at, lambda i: F.struct((i + 1).alias("line"), F.get(ls, i).alias("text"), F.slice(ls, low(i) + 1, i - low(i)).alias("before"), F.slice(ls, i + 2, F.lit(after)).alias("after")))

    # lines are bound to a name, so that they are split once a file
    with_roles = lambda ls: F.transform(F.array(roles(ls, language)), lambda kinds: hits(ls, kinds))[0]
    found = F.transform(F.array(text.lines(F.col("body"))), (lambda ls: hits(ls, None)) if role == "any" else with_roles)[0]
    return files.select("path", F.inline(found)).orderBy("path", "line")


def read_lines(files: DataFrame, start: int = 1, end: int | None = None, most: int = 1000) -> DataFrame:
    """(path, total_lines, text) with lines *start* to *end* of each file, *most* at most."""
    if end is not None and start > end:
        raise ValueError("start is beyond end")
    n = most if end is None else min(most, end - start + 1)
    rows = files.select("path", text.lines(F.col("body")).alias("lines"))
    return rows.select("path", F.size("lines").alias("total_lines"), F.array_join(F.slice("lines", max(start, 1), n), "\n").alias("text"))


def chunks(files: DataFrame, size: int = 8192, most: int | None = None) -> DataFrame:
    """(path, chunk_id, start, text): overlapping stretches of *size* characters, an eighth shared, to the end of the text or *most* a file."""
    step = size - size // 8
    n = F.char_length("body")
    end = F.ceil((n - size) / step).cast("int")
    if most is not None:
        end = F.least(end, F.lit(most - 1))
    starts = F.sequence(F.lit(0), F.greatest(end, F.lit(0)))
    rows = files.where(n > 0).select("path", "body", F.explode(starts).alias("chunk_id"))
    return rows.select("path", "chunk_id", (F.col("chunk_id") * step).alias("start"), F.substring(F.col("body"), F.col("chunk_id") * step + 1, F.lit(size)).alias("text"))
