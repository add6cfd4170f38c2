"""Directory trees as wide rows: listing, excludes, detection, attributes, archive entries, a parsed-attribute cache."""

from __future__ import annotations

import fnmatch
import functools
import io
import os
import re
import stat
import tarfile
import zipfile

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema
from quarry.functions import scalars, text
from quarry.operators import lines
from quarry.runtime import delete, shuffle_partitions, slices, stored
from quarry.sources import detect, parsers

#: Bytes of a file that detection sees.
HEAD_BYTES = 1 << 16
#: Lines of a source file in which a generator says so.
GENERATED_LINES = 20


LISTED = "path string, name string, root string, size bigint, modified double, is_dir boolean, is_symlink boolean, target_path string, is_broken_symlink boolean"


def _list(skip: str, follow: bool, artefacts: dict[str, list[str]]):
    def run(batches):
        for pdf in batches:
            rows = []
            for folder, root in zip(pdf["path"], pdf["root"]):
                try:
                    entries = sorted(os.scandir(folder), key=lambda e: e.name)
                except OSError:
                    continue
                built = {x for e in entries for x in artefacts.get(e.name, ())}
                for e in entries:
                    if e.name in built and e.is_dir(follow_symlinks=False):
                        continue
                    if skip and re.match(skip, e.name):
                        continue
                    link = e.is_symlink()
                    try:
                        seen = e.stat(follow_symlinks=follow or not link)
                        broken = link and not os.path.exists(e.path)
                    except OSError:
                        seen, broken = e.stat(follow_symlinks=False), True
                    folder_like = stat.S_ISDIR(seen.st_mode)
                    if folder_like or stat.S_ISREG(seen.st_mode) or (link and not follow) or broken:
                        rows.append((e.path, e.name, root, seen.st_size, seen.st_mtime, folder_like, link, os.readlink(e.path) if link else "", broken))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LISTED.split(", ")])

    return run


def _reader(most: int):
    """A column function from paths to the first *most* bytes of the files (-1: all); null where there is no path or no such file."""

    def one(path: str | None) -> bytes | None:
        if not isinstance(path, str):
            return None
        try:
            with open(path, "rb") as f:
                return f.read(most)
        except OSError:
            return None

    def read(paths: pd.Series) -> pd.Series:
        return pd.Series([one(p) for p in paths], dtype=object)

    return F.pandas_udf(read, "binary")


def _glob_test(patterns: list[str], git_dir: bool) -> str:
    """One expression for all globs over a name; .git is one unless *git_dir*."""
    globs = [*patterns, *([] if git_dir else [".git"])]
    return "|".join(f"(?:{fnmatch.translate(g)})" for g in globs)


def walk(spark: SparkSession, *roots: str, exclude_globs: list[str] = (), git_dir: bool = False, follow_symlinks: bool = False, prune_artefacts: bool = False, content: bool = True) -> DataFrame:
    """Every regular file under the *roots*: path, name, dir, ext, size, mod_time, rel, link columns, head and, with *content*, content (each read only if used).

    Hidden and empty files count.  Folders are listed by the executors, one level
    a round, so an excluded folder is never entered, nor with *prune_artefacts*
    one that a project beside it builds (see ARTEFACTS); they must be mounted where
    executors run.  Links stay rows of their own unless *follow_symlinks*.
    """
    test = _glob_test(list(exclude_globs), git_dir)
    front = spark.createDataFrame([(r.rstrip("/") or "/", r.rstrip("/") or "/") for r in roots], "path string, root string")
    found = None
    while True:
        level = stored(front.mapInPandas(_list(test, follow_symlinks, ARTEFACTS if prune_artefacts else {}), LISTED), "listing")
        here = level.where(~F.col("is_dir"))
        found = here if found is None else found.unionByName(here)
        front = level.where("is_dir").select("path", "root").repartition(shuffle_partitions(spark))
        if level.where("is_dir").isEmpty():
            break
    return found.select(
        "path",
        "name",
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("ext"),
        "size",
        F.to_utc_timestamp(F.timestamp_micros((F.col("modified") * 1_000_000).cast("bigint")), F.current_timezone()).cast("timestamp_ntz").alias("mod_time"),
        F.expr("substring(path, length(root) + 2)").alias("rel"),
        "is_symlink",
        "target_path",
        "is_broken_symlink",
        _reader(HEAD_BYTES)("path").alias("head"),
        *([_reader(-1)("path").alias("content")] if content else []),
    )


def walk_store(spark: SparkSession, *roots: str) -> DataFrame:
    """As walk(), from a store that only Spark reads; its file listing leaves out hidden and empty files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    rel = F.col("path")
    for root in roots:
        rel = F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)).otherwise(rel)
    name = F.element_at(F.split("path", "/"), -1)
    mod_time = F.to_utc_timestamp("modificationTime", F.current_timezone()).cast("timestamp_ntz")
    return raw.select("path", name.alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), F.col("length").alias("size"), mod_time.alias("mod_time"), rel.alias("rel"), "content")


def exclude(files: DataFrame, patterns: list[str], git_dir: bool = False) -> DataFrame:
    """Without files of which any path part below the root matches a glob; .git goes unless *git_dir*."""
    test = _glob_test(patterns, git_dir).replace(r"\Z", "").replace(r"\z", "")
    return files.where(~F.exists(F.split("rel", "/"), lambda p: p.rlike(f"^(?:{test})$"))) if test else files


_IGNORE = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def gitignore(files: DataFrame, rules: str) -> DataFrame:
    """Without what the root ignore file's *rules* ignore: **, ! and [classes] are known, the last rule that matches counts."""
    verdict: Column = F.lit(False)
    for line in rules.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule.lstrip("!")
        anchored = "/" in rule.rstrip("/")
        folder = rule.endswith("/")
        body = "".join(_IGNORE.get(x, x if x[0] == "[" and len(x) > 1 else re.escape(x)) for x in re.findall(r"\*\*/|/\*\*|\*\*|\[!?\]?[^\]]*\]|.", rule.strip("/")))
        body = re.sub(r"(?<!\\)\[!", "[^", body)
        pattern = ("^" if anchored else "(?:^|/)") + body + ("/.*$" if folder else "(?:/.*)?$")
        verdict = F.when(F.col("rel").rlike(pattern), F.lit(not keep)).otherwise(verdict)
    return files.where(~verdict)


#: Folders that builds leave behind, by the file that marks a project.
ARTEFACTS = {"package.json": ["node_modules", "dist"], "Cargo.toml": ["target"], "pyproject.toml": ["__pycache__", ".venv", "build"], "go.mod": ["vendor"], "pom.xml": ["target"], "build.gradle": ["build", ".gradle"]}
PROJECT_TYPES = {"package.json": "node", "Cargo.toml": "rust", "pyproject.toml": "python", "setup.py": "python", "go.mod": "go", "pom.xml": "java", "build.gradle": "java", "Gemfile": "ruby", "composer.json": "php"}


def projects(files: DataFrame) -> DataFrame:
    """(root, project_type): folders that hold a project's marking file."""
    table = F.create_map(*(F.lit(x) for pair in PROJECT_TYPES.items() for x in pair))
    return files.where(F.col("name").isin(list(PROJECT_TYPES))).groupBy(F.col("dir").alias("root")).agg(F.min(F.try_element_at(table, F.col("name"))).alias("project_type"))


def without_artefacts(files: DataFrame) -> DataFrame:
    """Without the build folders of the projects that the files themselves show."""
    table = F.create_map(*(x for k, v in ARTEFACTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    found = files.where(F.col("name").isin(list(ARTEFACTS))).select(F.explode(F.transform(F.try_element_at(table, F.col("name")), lambda a: F.concat_ws("/", "dir", a))).alias("gone")).distinct()
    parts = F.split("dir", "/")
    ups = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("gone"))
    return files.join(ups.join(found, "gone").select("path").distinct(), "path", "left_anti")


def detected(files: DataFrame) -> DataFrame:
    """*files* with content_type, magic_content_type, extension_content_type and is_disguised."""
    head = F.col("head" if "head" in files.columns else "content")
    named, magic = F.coalesce(detect.by_name(F.col("name")), F.lit("")), F.coalesce(detect.by_magic(F.substring(head, 1, 512)), F.lit(""))
    out = files.withColumns({"content_type": detect.content_type(F.col("name"), head), "extension_content_type": named, "magic_content_type": magic})
    return out.drop("head").withColumn("is_disguised", (F.col("magic_content_type") != "") & (F.col("extension_content_type") != "") & (F.col("magic_content_type") != F.col("extension_content_type")))


# Content types that a profile does not parse (it still detects them).
PROFILES = {"code": ("image/", "audio/", "video/", "binary/", "bytecode/", "install/", "disk-image/", "archive/", "office/", "epub", "email/", "science/", "database/", "font/", "3d/", "chat/", "browser/", "bookmark/")}

_TEXTS = ("text", "markdown", "csv", "json", "yaml", "toml", "xml", "html", "manifest/", "repo/", "ignore/", "build/", "source/", "platform/", "notebook/", "email/", "chat/", "image/svg")


def attributes(files: DataFrame, *, body_bytes: int | None = None, profile: str | None = None) -> DataFrame:
    """*files* (detected) with body and the attributes of their families.

    Text attributes are columns; other families go through one Arrow parser per
    batch.  What cannot be parsed keeps its row, with attributes missing.  Bodies
    and counts are those of whole files; with *body_bytes* text bodies end there
    and is_body_truncated tells of which.  Files without a ``content`` column are
    read here, but for those whose type has neither text nor a parser, or is in a
    *profile* (see PROFILES).
    """
    ct = F.col("content_type")
    is_text = F.lit(False)
    for t in _TEXTS:
        is_text = is_text | ct.startswith(t)
    wanted = is_text
    for t in parsers.PARSED:
        wanted = wanted | ct.startswith(t)
    for prefix in PROFILES[profile] if profile is not None else ():
        wanted = wanted & ~ct.startswith(prefix)
    if "content" in files.columns:
        files = files.withColumn("content", F.when(wanted, F.col("content")))
    else:
        files = files.withColumn("content", _reader(-1)(F.when(wanted, F.col("path"))))
    parsed = files.mapInPandas(_parse, _schema(files))
    body = F.coalesce("p_body", F.when(is_text, F.make_valid_utf8((F.col("content") if body_bytes is None else F.substring("content", 1, body_bytes)).cast("string"))))
    out = parsed.withColumn("body", F.when(F.length(F.coalesce(body, F.lit(""))) > 0, body)).drop("p_body")
    code = ct.startswith("source/")
    language = F.when(code, F.substring(ct, 8, 64))
    has = F.col("body").isNotNull()
    out = out.withColumns(
        {
            "line_count": F.when(has, text.line_count(F.col("body"))),
            "word_count": F.coalesce("word_count", F.when(has, text.word_count(F.col("body")))),
            "title": F.coalesce("title", F.when(ct == "html", F.nullif(text.html_title(F.col("body")), F.lit("")))),
            "language": F.coalesce("language", language, F.when(ct == "html", F.nullif(text.html_lang(F.col("body")), F.lit("")))),
            "frontmatter": F.try_parse_json("frontmatter"),
            "json_kind": F.when(ct == "json", text.json_kind(F.col("body"))),
            "root_element": F.when(ct == "xml", text.xml_root(F.col("body"))),
            "license_id": F.when(ct == "repo/license", scalars.license_id(F.col("body"))),
            "is_test_file": F.when(code, test_file(F.col("name"), F.col("path"), language)),
            "is_generated_code": F.when(code, generated(F.col("body"), language)),
            **({} if body_bytes is None else {"is_body_truncated": F.coalesce(is_text & (F.length("content") > body_bytes), F.lit(False))}),
        }
    )
    counted = out.withColumn("__r", F.when(code & has, lines.roles(text.lines(F.col("body")), F.col("language"))))
    count = lambda role: F.when(F.col("__r").isNotNull(), F.size(F.filter("__r", lambda x: x == role)).cast("bigint"))
    return counted.withColumns({"loc": count("code"), "comment_loc": count("comment"), "blank_loc": count("blank")}).drop("__r")


_SCRIPTS = r"\.(?:test|spec)\.(?:[cm]?js|jsx|tsx?)$"
_C = r"(?:^test_.*|_tests?)\.(?:c|h|cpp|cc|cxx|hpp|hh|hxx)$"
# How the names of test files look in a language, in lower case.
TEST_FILES = {
    "go": r"_test\.go$",
    "python": r"_test\.py$|^test_.*\.py$",
    "javascript": _SCRIPTS,
    "typescript": _SCRIPTS,
    "c": _C,
    "cpp": _C,
    "java": r"(?:tests?|it)\.java$",
    "ruby": r"_(?:spec|test)\.rb$",
    "swift": r"tests?\.swift$",
    "kotlin": r"tests?\.kt$",
    "scala": r"(?:spec|test)\.scala$",
    "shell": r"_test\.sh$|^test_.*\.sh$",
    "elixir": r"_test\.exs$",
    "csharp": r"tests?\.cs$",
    "php": r"test\.php$",
    "perl": r"\.t$",
    "r": r"^test[-_].*\.r$",
    "vb": r"tests?\.vb$",
    "matlab": r"tests?\.m$",
}


def test_file(name: Column, path: Column, language: Column) -> Column:
    """Whether a source file's name follows its language's convention for tests; in Rust, whether it lies in a folder of tests."""
    low, out = F.lower(name), F.lower(path).rlike(r"(?:^|/)tests/") & (language == "rust")
    for own, pattern in TEST_FILES.items():
        out = F.when(language == own, low.rlike(pattern)).otherwise(out)
    return F.coalesce(out, F.lit(False))


# What a generator writes into a file of a language, in lower case.
GENERATED = {
    "go": ["// code generated "],
    "python": ["# generated by", "# generated automatically", "# autogenerated", "# this file is autogenerated", "# do not edit", "# @generated"],
    "java": ["// generated by", "@javax.annotation.generated", "@generated", "// do not edit"],
    "kotlin": ["// generated by", "@generated", "// do not edit"],
    "scala": ["// generated by", "// do not edit", "@generated"],
    "csharp": ["// <auto-generated", "<auto-generated>", "// generated by", "// do not edit"],
    "javascript": ["// @generated", "// this file is auto-generated", "// do not edit", "// generated by"],
    "typescript": ["// @generated", "// this file is auto-generated", "// do not edit", "// generated by"],
    "rust": ["// @generated", "// auto-generated", "// generated by", "// do not edit"],
    "ruby": ["# @generated", "# generated by", "# do not edit"],
    "swift": ["// generated by", "// do not edit", "// @generated"],
    "perl": ["# generated by", "# do not edit"],
    "shell": ["# generated by", "# do not edit", "# @generated"],
    "php": ["// @generated", "// generated by", "// do not edit", "# generated by"],
}


def generated(body: Column, language: Column) -> Column:
    """Whether one of the first GENERATED_LINES lines holds a mark of the language's generators."""
    head = F.lower(F.substring_index(body, "\n", GENERATED_LINES))
    out = F.lit(False)
    for name, marks in GENERATED.items():
        held = F.lit(False)
        for mark in marks:
            held = held | head.contains(mark)
        out = F.when(language == name, held).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _schema(files: DataFrame) -> str:
    """The columns of *files*, the parser's body, and one column per attribute that parsers can find."""
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields]
    return ", ".join([*own, "p_body string", *(f"`{n}` {schema.SPARK_TYPES[schema.TYPES[n]] if n != 'frontmatter' else 'string'}" for n in parsers.ATTRIBUTES)])


def _parse(batches):
    for whole in batches:
        for start, end in slices(whole["content"]):
            pdf = whole.iloc[start:end]
            rows = [parsers.parse(k, n, c) for k, n, c in zip(pdf["content_type"], pdf["name"], pdf["content"])]
            found = {"p_body": [b for b, _ in rows]} | {a: [x.get(a) for _, x in rows] for a in parsers.ATTRIBUTES}
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in found.items()})], axis=1)


def scan(spark: SparkSession, *roots: str, exclude_globs: list[str] = (), ignore_rules: str = "", prune_artefacts: bool = False, body_bytes: int | None = None, profile: str | None = None) -> DataFrame:
    """The whole source: listing, excludes, detection and attributes, ready for any search."""
    files = walk(spark, *roots, exclude_globs=list(exclude_globs), prune_artefacts=prune_artefacts, content=False)
    if ignore_rules:
        files = gitignore(files, ignore_rules)
    return attributes(detected(files), body_bytes=body_bytes, profile=profile).drop("rel")


def _entries(most: int | None, batches):
    for pdf in batches:
        for path, name, content in zip(pdf["path"], pdf["name"], pdf["content"]):
            found = []
            try:
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = [(i.filename, i.file_size, z.read(i) if most is None or i.file_size <= most else None) for i in z.infolist() if not i.is_dir()]
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        found = [(m.name, m.size, t.extractfile(m).read() if most is None or m.size <= most else None) for m in t if m.isfile()]
            except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError, RuntimeError):
                found = []
            rows = [(f"{path}#{n}", n.rsplit("/", 1)[-1], path, n, s, c) for n, s, c in found]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "name", "archive", "entry", "size", "content"])


def archive_entries(files: DataFrame, entry_bytes: int | None = None) -> DataFrame:
    """The files inside archives as rows: path archive#entry, name, dir, ext, size, rel, content (null over *entry_bytes*, if given)."""
    held = files.where(F.col("content_type").startswith("archive/") | F.col("name").rlike(r"(?i)\.(zip|jar|tar|tgz|tar\.gz)$")).select("path", "name", "content")
    out = held.mapInPandas(functools.partial(_entries, entry_bytes), "path string, name string, archive string, entry string, size bigint, content binary")
    return out.select("path", "name", F.col("archive").alias("dir"), F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("ext"), "size", F.lit(None).cast("timestamp_ntz").alias("mod_time"), F.col("entry").alias("rel"), "content")


def read_entry(files: DataFrame, archive: str, entry: str, most: int | None = None) -> DataFrame:
    """(path, content, is_truncated) of one entry: all of it, or its first *most* bytes."""
    one = archive_entries(files.where(F.col("path") == archive)).where(F.col("rel") == entry)
    cut = F.col("content") if most is None else F.substring("content", 1, most)
    return one.select("path", cut.alias("content"), (F.length("content") > F.length(cut)).alias("is_truncated"))


def cached(files: DataFrame, folder: str) -> DataFrame:
    """Attributes of *files* (detected) through a cache table: those known by (path, size, mod_time) are read, others parsed and added."""
    spark = files.sparkSession
    keys = ["path", "size", "mod_time"]
    try:
        known = spark.read.option("recursiveFileLookup", True).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    todo = files if known is None else files.join(known.select(*keys), keys, "left_anti")
    attributes(todo).drop("content", "rel").write.mode("append").parquet(folder)
    cache = spark.read.option("recursiveFileLookup", True).parquet(folder)
    return cache.join(files.select(*keys), keys, "left_semi")


def cache_list(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(path, content_type, size, mod_time) of the cache's entries below *prefix*, by path."""
    known = spark.read.option("recursiveFileLookup", True).parquet(folder)
    return known.where(F.col("path").startswith(prefix)).select("path", "content_type", "size", "mod_time").orderBy("path")


def cache_evict(spark: SparkSession, folder: str, prefix: str = "", older_than=None) -> int:
    """Drops the entries below *prefix* (all if blank) whose files changed before *older_than* (any time if none); how many went.

    What stays is written as a new batch before the old ones are deleted.
    """
    known = spark.read.option("recursiveFileLookup", True).parquet(folder)
    test = F.col("path").startswith(prefix)
    if older_than is not None:
        test = test & (F.col("mod_time") < F.lit(older_than))
    before, old = known.count(), [f.rsplit("/", 1) for f in known.inputFiles()]
    kept = stored(known.where(~F.coalesce(test, F.lit(False))), "kept")
    kept.write.mode("append").parquet(folder)
    for parent, name in old:
        delete(spark, f"{parent}/{name}")
    return before - kept.count()


def cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    """(content_type, entries, bytes) of the cache."""
    return spark.read.option("recursiveFileLookup", True).parquet(folder).groupBy("content_type").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))
