"""Filter, rank, sort, top-K and keyset pages over a files table."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import relevance
from quarry.plans import cel
from quarry.runtime import stored
from quarry.sources.tables import variables

#: Columns a projection always keeps.
ALWAYS = ("path", "content_type", "size")


def where(files: DataFrame, expression: str = "") -> DataFrame:
    """The rows for which *expression* is true; an empty one keeps all, an evaluation error drops the row."""
    return files.where(cel.predicate(expression, variables(files))) if expression.strip() else files


def ranked(files: DataFrame, expression: str) -> DataFrame:
    """*files* with a double column ``rank``; an evaluation error ranks 0."""
    return files.withColumn("rank", cel.rank(expression, variables(files)))


def sort_columns(key: str, order: str, tie: str = "path") -> list:
    """Missing values last when rising, first when falling; ties by rising path."""
    first = F.col(key).desc_nulls_first() if order == "desc" else F.col(key).asc_nulls_last()
    return [first, F.col(tie).asc()]


def above(expression: str, threshold: float = 0.5) -> str:
    """*expression* and a similarity of *threshold* or more."""
    test = f"similarity >= double({float(threshold)!r})"
    return f"({expression}) && {test}" if expression.strip() else test


def search(
    files: DataFrame,
    expression: str = "",
    *,
    sort: str | None = None,
    order: str = "asc",
    rank: str | None = None,
    limit: int | None = None,
    fields: list[str] | None = None,
    keywords: str | None = None,
    threshold: float | None = None,
    hybrid: bool = False,
) -> DataFrame:
    """Filter, then rank, sort and cut.  A rank without a sort key sorts by rank, falling; an unknown key sorts nothing.

    *keywords* gives the files that pass the filter a bm25 column, over just
    these files.  They are then ranked by *rank*, which may use bm25; with
    *hybrid* by the reciprocal ranks of bm25 and similarity added up; else by
    bm25.  *threshold* keeps files of that similarity or more (0 is a threshold
    too) and, without another order, sorts by similarity, falling.
    """
    if threshold is not None:
        expression = above(expression, threshold)
        if sort is None and rank is None and keywords is None:
            sort, order = "similarity", "desc"
    found = where(files, expression)
    if hybrid and (keywords is None or "similarity" not in found.columns):
        raise ValueError("a hybrid search takes keywords and files with a similarity")
    if keywords is not None:
        scores = relevance.bm25(found, keywords)
        if hybrid:
            scored = stored(scores.join(found.select("path", F.coalesce("similarity", F.lit(0.0)).alias("similarity")), "path"), "hybrid")
            scores = scores.join(relevance.fuse(scored, scored, "bm25", "similarity").withColumnRenamed("rrf", "rank"), "path")
        found = found.drop("bm25").join(scores, "path")
        if not hybrid and rank is None:
            found = found.withColumn("rank", F.col("bm25"))
    if rank is not None and not hybrid:
        found = ranked(found, rank)
    if sort is None and (rank is not None or keywords is not None):
        sort, order = "rank", "desc"
    sortable = sort is not None and sort in found.columns and not dict(found.dtypes)[sort].startswith(("array", "map", "struct"))
    if sortable:
        found = found.orderBy(*sort_columns(sort, order))
    if limit is not None and limit > 0:
        found = found.limit(limit)
    return project(found, fields) if fields is not None else found


def project(found: DataFrame, fields: list[str]) -> DataFrame:
    """Only *fields* and those of ALWAYS; an unknown one is an error."""
    unknown = [f for f in fields if f not in found.columns]
    if unknown:
        raise cel.ExpressionError(f"unknown fields: {', '.join(unknown)}")
    keep = [*(c for c in ALWAYS if c in found.columns), *(f for f in fields if f not in ALWAYS)]
    return found.select(*keep)


def cursor(key: str, order: str, value, path: str) -> str:
    """An opaque token for the row after which the next page begins."""
    return base64.urlsafe_b64encode(json.dumps({"sort": key, "order": order, "value": value, "path": path}).encode()).decode()


def page(files: DataFrame, key: str, order: str, limit: int, token: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the page, the next page's token as a one-row table ``cursor``, empty at the end); nothing is collected.

    Rows are in the total order (key, then rising path).  A token made for another
    key or order is an error.
    """
    rows = files
    column, kind = F.col(key), dict(files.dtypes)[key]
    if token is not None:
        at = json.loads(base64.urlsafe_b64decode(token))
        if (at["sort"], at["order"]) != (key, order):
            raise ValueError("the cursor is for another order")
        same_later = F.col("path") > at["path"]
        if at["value"] is None:
            later = column.isNotNull() if order == "desc" else F.lit(False)
            rows = rows.where(later | (column.isNull() & same_later))
        else:
            value = F.lit(at["value"]).cast(kind)
            later = column < value if order == "desc" else (column > value) | column.isNull()
            rows = rows.where(later | ((column == value) & same_later))
    ahead = rows.orderBy(*sort_columns(key, order)).limit(limit + 1)
    here = ahead.orderBy(*sort_columns(key, order)).limit(limit)
    last = here.orderBy(F.col(key).asc_nulls_last() if order == "desc" else F.col(key).desc_nulls_first(), F.col("path").desc()).limit(1)
    more = ahead.agg((F.count("*") > limit).alias("more"))
    body = F.to_json(F.struct(F.lit(key).alias("sort"), F.lit(order).alias("order"), column.alias("value"), "path"), {"ignoreNullFields": "false"})
    return here, last.join(more, F.col("more")).select(F.base64(body.cast("binary")).alias("cursor"))


def tuple_page(rows: DataFrame, keys: list[str], orders: list[str], limit: int, *, scope: str = "", token: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the page, the next page's token as a one-row table ``cursor``, empty at the end) of any *rows*, ordered by *keys*, each rising or falling by *orders*.

    The keys together tell rows apart; nulls come first where a key rises and last
    where it falls.  A token made for another *scope* or order is an error.
    """
    orders = ["desc" if o == "desc" else "asc" for o in orders]
    kinds, after = dict(rows.dtypes), rows
    if token is not None:
        at = json.loads(base64.urlsafe_b64decode(token))
        if at["scope"] != scope:
            raise ValueError(f"the cursor is for {at['scope']!r}, not {scope!r}")
        if at["orders"] != orders:
            raise ValueError("the cursor is for another order")
        later, same = F.lit(False), F.lit(True)
        for key, order, value in zip(keys, orders, at["key"]):
            column, held = F.col(key), F.lit(value).cast(kinds[key])
            if order == "desc":
                beyond = F.lit(False) if value is None else column.isNull() | (column < held)
            else:
                beyond = column.isNotNull() if value is None else column > held
            later = later | (same & F.coalesce(beyond, F.lit(False)))
            same = same & column.eqNullSafe(held)
        after = rows.where(later)
    up = [F.col(k).asc_nulls_first() if o == "asc" else F.col(k).desc_nulls_last() for k, o in zip(keys, orders)]
    down = [F.col(k).desc_nulls_last() if o == "asc" else F.col(k).asc_nulls_first() for k, o in zip(keys, orders)]
    ahead = after.orderBy(*up).limit(limit + 1)
    here = ahead.orderBy(*up).limit(limit)
    more = ahead.agg((F.count("*") > limit).alias("more"))
    body = F.to_json(F.struct(F.lit(scope).alias("scope"), F.array(*map(F.lit, orders)).alias("orders"), F.array(*(F.col(k).cast("string") for k in keys)).alias("key")), {"ignoreNullFields": "false"})
    last = here.orderBy(*down).limit(1)
    return here, last.join(more, F.col("more")).select(F.base64(body.cast("binary")).alias("cursor"))


# The named queries.  {since} stands for an instant.
PRESETS = {
    "recent_changes": {"expression": 'mod_time > timestamp("{since}")', "sort": "mod_time", "order": "desc", "limit": 50},
    "recent_photos": {"expression": 'is_image && taken_at > timestamp("{since}")', "sort": "taken_at", "order": "desc", "limit": 50},
    "old_drafts": {"expression": 'is_markdown && draft && mod_time < timestamp("{since}")', "sort": "mod_time", "order": "asc"},
    "large_files": {"expression": "size > 100000000", "sort": "size", "order": "desc", "limit": 20},
    "large_binaries": {"expression": "is_binary && size > 100000000", "sort": "size", "order": "desc", "limit": 20},
    "suspicious_files": {"expression": "is_disguised || is_btime_anomaly"},
    "failed_tests": {"expression": r'is_source && is_test_file && body.matches("(?m)^\\s*(//|#|--|;)\\s*\\b(FAIL|FIXME|XXX|TODO)\\b")'},
    "system_metadata": {"expression": "is_system_metadata"},
    "recent_commits": {"expression": 'git_last_commit_time > timestamp("{since}")', "sort": "git_last_commit_time", "order": "desc", "limit": 50},
    "hot_files": {"expression": "is_git_tracked && git_commit_count > 0", "sort": "git_commit_count", "order": "desc", "limit": 20},
    "hotspots": {"expression": "is_source && is_git_tracked && git_commit_count > 0 && max_complexity > 0", "rank": "double(max_complexity) * double(git_commit_count)", "order": "desc", "limit": 20},
    "prod_code": {"expression": "is_source && is_git_tracked && !is_test_file && !is_generated_code", "sort": "loc", "order": "desc", "limit": 100},
    "untracked_code": {"expression": "is_source && !is_git_tracked && !is_git_ignored", "sort": "size", "order": "desc", "limit": 50},
    "generated_code": {"expression": "is_source && is_generated_code", "sort": "size", "order": "desc", "limit": 50},
    "test_files": {"expression": "is_source && is_test_file", "sort": "loc", "order": "desc", "limit": 50},
    "large_ebooks": {"expression": "is_epub", "sort": "size", "order": "desc", "limit": 20},
    "recent_ebooks": {"expression": 'is_epub && mod_time > timestamp("{since}")', "sort": "mod_time", "order": "desc", "limit": 50},
    "untagged_ebooks": {"expression": 'is_epub && (title == "" || author == "")', "sort": "name", "order": "asc"},
    "non_english_ebooks": {"expression": 'is_epub && language != "" && language != "en"', "sort": "name", "order": "asc"},
}


def preset(files: DataFrame, name: str, since: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A named query; *since* is the instant that time-relative ones compare with."""
    options = dict(PRESETS[name])
    return search(files, options.pop("expression").replace("{since}", since), **options)
