"""Histograms, exact duplicates, known hashes, tree set operations, ownership and chat summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.runtime import join_each, stored

# What a file can be grouped by.
STRING_KEYS = ("content_type", "ext", "language", "camera_make", "camera_model", "author", "artist", "album", "genre", "dir", "project_type", "source", "video_codec", "audio_codec")
TIME_KEYS = ("mod_time", "created_at", "taken_at", "date", "sent_at", "git_last_commit_time")
_FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}


def bucket(files: DataFrame, group_by: str) -> Column:
    """The bucket name of a string key, or of <time key>_<year|month|day>; an unknown key groups by content type."""
    time, _, unit = group_by.rpartition("_")
    if unit in _FORMATS and time and time in files.columns:
        c = F.col(time)
        none = c.isNull() | (c == F.expr("TIMESTAMP_NTZ'0001-01-01 00:00:00'"))
        return F.when(none, "(no date)").otherwise(F.date_format(c, _FORMATS[unit]))
    key = group_by if group_by in STRING_KEYS else "content_type"
    if key not in files.columns:
        return F.lit("unknown")
    return F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("(no ext)" if key == "ext" else "unknown"))


def histogram(files: DataFrame, group_by: str = "content_type") -> DataFrame:
    """(bucket, count, total_size), largest count first, then by name."""
    size = F.col("size") if "size" in files.columns else F.lit(0).cast("bigint")
    out = files.groupBy(bucket(files, group_by).alias("bucket")).agg(F.count("*").alias("count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"))
    return out.orderBy(F.col("count").desc(), "bucket")


def totals(files: DataFrame, group_by: str = "content_type") -> DataFrame:
    """The histogram with a grand total in the same pass; its bucket is null."""
    keyed = files.select(bucket(files, group_by).alias("bucket"), "size")
    return keyed.rollup("bucket").agg(F.count("*").alias("count"), F.sum("size").alias("total_size"))


def _hashed_twins(files: DataFrame, min_size: int) -> DataFrame:
    """(path, size, sha256) of the files whose size occurs twice."""
    sized = files.where((F.col("size") > 0) & (F.col("size") >= min_size))
    twice = sized.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    return sized.join(twice, "size", "left_semi").select("path", "size", F.sha2(F.col("body").cast("binary"), 256).alias("sha256"))


def duplicate_members(files: DataFrame, min_size: int = 1) -> DataFrame:
    """(sha256, path, size, count) of every file whose body occurs twice or more: a row each, so groups of any size are spread."""
    hashed = stored(_hashed_twins(files, min_size), "hashed")
    groups = hashed.groupBy("sha256").agg(F.count("*").alias("count")).where("count > 1")
    return join_each(hashed, groups.withColumn("__n", F.col("count")), "sha256").select("sha256", "path", "size", "count")


def duplicates(files: DataFrame, min_size: int = 1, paths: bool = True) -> DataFrame:
    """Groups of equal bodies: sha256, size, count, wasted, paths (sorted); most wasted first, then by hash.

    Only sizes that occur twice are hashed.  The paths of a group are one list and
    so in one task: for groups without bound leave them out and take
    duplicate_members().
    """
    hashed = _hashed_twins(files, min_size)
    listed = [F.array_sort(F.collect_list("path")).alias("paths")] if paths else []
    groups = hashed.groupBy("sha256").agg(F.min("size").alias("size"), F.count("*").alias("count"), *listed).where("count > 1")
    return groups.withColumn("wasted", (F.col("count") - 1) * F.col("size")).orderBy(F.col("wasted").desc(), "sha256")


def known_flags(files: DataFrame, hashes: DataFrame, name: str = "is_known_good") -> DataFrame:
    """*files* with a flag for those of which any digest (md5, sha1, sha256 of the body) is in *hashes* (algo, hex)."""
    body = F.col("body").cast("binary")
    digests = {"md5": F.md5(body), "sha1": F.sha1(body), "sha256": F.sha2(body, 256)}
    out = files
    for algo, digest in digests.items():
        own = hashes.where(F.col("algo") == algo).select(F.lower("hex").alias(f"__{algo}")).distinct().withColumn(f"__in_{algo}", F.lit(True))
        out = out.join(own, digest == F.col(f"__{algo}"), "left").drop(f"__{algo}")
    flag = F.coalesce(*(F.col(f"__in_{a}") for a in digests), F.lit(False))
    return out.withColumn(name, flag).drop(*(f"__in_{a}" for a in digests))


def hash_trio(files: DataFrame) -> DataFrame:
    """*files* with md5, sha1 and sha256 of the body."""
    body = F.col("body").cast("binary")
    return files.withColumns({"md5": F.md5(body), "sha1": F.sha1(body), "sha256": F.sha2(body, 256)})


def diff(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Set operations of two trees by content: a-minus-b, b-minus-a, intersect, union, mismatch.

    *a* and *b* have path (relative), size and body; empty files do not count.
    The minus operations give every path; intersect and union one row a content,
    with its least path on either side; mismatch pairs equal paths of different
    content.  Columns: path_a, path_b, sha256, sha256_b, status, ordered by the first three.
    """
    side = lambda t, x: t.where("size > 0").select(F.col("path").alias(f"path_{x}"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"))
    left, right = side(a, "a"), side(b, "b")
    none = F.lit(None).cast("string")
    if op == "a-minus-b":
        return left.join(right, "sha256", "left_anti").select("path_a", none.alias("path_b"), "sha256", none.alias("sha256_b"), F.lit("only_a").alias("status")).orderBy("path_a", "path_b", "sha256")
    if op == "b-minus-a":
        return right.join(left, "sha256", "left_anti").select(none.alias("path_a"), "path_b", "sha256", none.alias("sha256_b"), F.lit("only_b").alias("status")).orderBy("path_a", "path_b", "sha256")
    if op == "mismatch":
        other = right.withColumnRenamed("sha256", "sha256_b")
        met = left.join(other, (F.col("path_a") == F.col("path_b")) & (F.col("sha256") != F.col("sha256_b")))
        return met.select("path_a", "path_b", "sha256", "sha256_b", F.lit("mismatch").alias("status")).orderBy("path_a", "path_b", "sha256")
    first_a = left.groupBy("sha256").agg(F.min("path_a").alias("path_a"))
    first_b = right.groupBy("sha256").agg(F.min("path_b").alias("path_b"))
    if op not in ("intersect", "union"):
        raise ValueError(f"unknown operation {op!r}")
    met = first_a.join(first_b, "sha256", "inner" if op == "intersect" else "full_outer")
    status = F.when(F.col("path_b").isNull(), "only_a").when(F.col("path_a").isNull(), "only_b").otherwise("both")
    return met.select("path_a", "path_b", "sha256", none.alias("sha256_b"), status.alias("status")).orderBy("path_a", "path_b", "sha256")


def api_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, kind, change): exported names that were added or removed; removed ones break."""
    b, a = before.select("name", "kind").distinct(), after.select("name", "kind").distinct()
    return a.join(b, ["name", "kind"], "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, ["name", "kind"], "left_anti").withColumn("change", F.lit("removed")))


def churn_owners(files: DataFrame, min_files: int = 1) -> DataFrame:
    """Per dir: files, authors, top_author (most files, then name), share, commits; few authors first, then many commits.

    *files* has dir, git_last_commit_author and git_commit_count; files without an
    author count as files.
    """
    by = files.groupBy("dir", F.nullif(F.col("git_last_commit_author"), F.lit("")).alias("author")).agg(F.count("*").alias("n"), F.sum(F.coalesce("git_commit_count", F.lit(0))).alias("commits"))
    named = F.col("author").isNotNull()
    best = F.min(F.when(named, F.struct((-F.col("n")).alias("minus"), "author")))
    out = by.groupBy("dir").agg(F.sum("n").alias("files"), F.count("author").alias("authors"), best.alias("top"), F.sum("commits").alias("commits")).where(F.col("files") >= min_files)
    share = F.coalesce(-F.col("top.minus") / F.col("files"), F.lit(0.0))
    return out.select("dir", "files", "authors", F.coalesce("top.author", F.lit("")).alias("top_author"), share.alias("share"), "commits").orderBy("authors", F.col("commits").desc(), "dir")


def chat_summary(turns: DataFrame, cap: int | None = None) -> DataFrame:
    """Per conversation: message_count, participants (sorted), body of all turns, or those below *cap*, as role, tab, text lines.

    *turns* has conv_id, turn, role and text.  Turns without a number come last.
    A conversation of any length is counted in parts; its body is one string, so
    one task puts it together.
    """
    counted = turns.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("participants"))
    told = turns if cap is None else turns.where(F.col("turn") < cap)
    first = told.groupBy(F.col("conv_id").alias("__c")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("unnumbered"), "turn", "role", "text"))).alias("t"))
    body = F.array_join(F.transform("t", lambda x: F.concat_ws("\t", x["role"], x["text"])), "\n")
    return counted.join(first.select("__c", body.alias("body")), F.col("conv_id").eqNullSafe(F.col("__c")), "left").drop("__c")


def nearest_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """*files* with project_root and project_type of the nearest folder above (or at) dir that is in *projects* (root, project_type)."""
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = files.select("dir").distinct().withColumn("root", F.explode(ups))
    found = dirs.join(projects, "root").groupBy("dir").agg(F.max_by(F.struct("root", "project_type"), F.length("root")).alias("p"))
    return files.join(found, "dir", "left").withColumns({"project_root": F.col("p.root"), "project_type": F.col("p.project_type")}).drop("p")


def with_git(files: DataFrame, log: DataFrame) -> DataFrame:
    """*files* with the git columns of *log* (path, last_commit_time, last_author, last_subject, first_seen, commit_count)."""
    renamed = log.select("path", F.col("last_commit_time").alias("git_last_commit_time"), F.col("last_author").alias("git_last_commit_author"), F.col("last_subject").alias("git_last_commit_subject"), F.col("first_seen").alias("git_first_seen"), F.col("commit_count").alias("git_commit_count"), F.lit(True).alias("is_git_tracked"))
    return files.join(renamed, "path", "left")


def live_photos(files: DataFrame) -> DataFrame:
    """Still images and clips of one name in one folder: (image_path, video_path, video_size)."""
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    images = files.where(F.lower("ext").isin(".heic", ".heif", ".jpg", ".jpeg")).select("dir", stem.alias("stem"), F.col("path").alias("image_path"))
    clips = files.where(F.lower("ext") == ".mov").select("dir", stem.alias("stem"), F.col("path").alias("video_path"), F.col("size").alias("video_size"))
    return images.join(clips, ["dir", "stem"]).select("image_path", "video_path", "video_size")
