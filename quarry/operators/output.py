"""What comes out of a search: lines of several formats, reports for code scanners, and trees of links or copies."""

from __future__ import annotations

import os
import re
import shutil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Columns that are never shown.
_HIDDEN = ("content", "head", "body")


def ndjson(found: DataFrame) -> DataFrame:
    """(value): one JSON object a row, without missing attributes; write it with .write.text()."""
    shown = [c for c in found.columns if c not in _HIDDEN]
    return found.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in shown))).alias("value"))


def bare(found: DataFrame) -> DataFrame:
    """(value): paths only."""
    return found.select(F.col("path").alias("value"))


def default(found: DataFrame) -> DataFrame:
    """(value): path and content type, separated by a tab."""
    return found.select(F.concat_ws("\t", "path", "content_type").alias("value"))


def verbose(found: DataFrame) -> DataFrame:
    """(value): path, type and size, then each attribute that is there, on lines of their own."""
    first = ("path", "content_type", "size")
    rest = [c for c, t in found.dtypes if c not in (*first, *_HIDDEN) and t not in ("binary", "variant")]
    text = lambda c, t: F.array_join(F.col(f"`{c}`").cast("array<string>"), ", ") if t.startswith("array") else F.col(f"`{c}`").cast("string")
    kinds = dict(found.dtypes)
    own = [F.when(F.length(text(c, kinds[c])) > 0, F.concat(F.lit(f"  {c}: "), text(c, kinds[c]))) for c in rest]
    head = F.concat(F.col("path"), F.lit(" ["), F.coalesce("content_type", F.lit("")), F.lit("] "), F.coalesce(F.col("size").cast("string"), F.lit("0")), F.lit(" bytes"))
    return found.select(F.concat_ws("\n", head, *own).alias("value"))


_FIELD = re.compile(r"\{\{\s*\.([A-Za-z_]\w*)\s*\}\}")
_TOKEN = re.compile(r"\{([A-Za-z0-9_]+)\}")


def _column(found: DataFrame, name: str) -> str | None:
    """The column that a template names, as Path, ContentType or content_type."""
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
    return next((c for c in (name, snake) if c in found.columns), None)


def template(found: DataFrame, form: str) -> DataFrame:
    """(value): *form* with {{.Name}} replaced by the row's attribute; a missing value is blank, an unknown name is an error."""
    parts, at = [], 0
    for m in _FIELD.finditer(form):
        column = _column(found, m[1])
        if column is None:
            raise ValueError(f"unknown field in template: {m[1]}")
        parts += [F.lit(form[at : m.start()]), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))]
        at = m.end()
    return found.select(F.concat(*parts, F.lit(form[at:])).alias("value"))


def sarif(found: DataFrame, rule: str, description: str, message: Column, *, line: str | None = "line", level: str = "warning", tool: str = "quarry", version: str = "1") -> DataFrame:
    """(value): one SARIF 2.1.0 document with a result for each row of *found* (path, *line* or none), by path and line.

    Results are one JSON document, so one task puts them together; for reports
    without bound write sarif_results() as lines.
    """
    results = sarif_results(found, rule, message, line=line, level=level)
    log = results.agg(F.array_sort(F.collect_list(F.struct("path", "line", "result"))).alias("r")).select(F.transform("r", lambda x: x["result"]).alias("results"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.array(F.struct(F.lit(rule).alias("id"), F.struct(F.lit(description).alias("text")).alias("shortDescription"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))
    return log.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.array(run).alias("runs"))).alias("value"))


def sarif_results(found: DataFrame, rule: str, message: Column, *, line: str | None = "line", level: str = "warning") -> DataFrame:
    """(path, line, result): SARIF results as structs; messages of more than 200 characters are shortened, as viewers show one line."""
    short = F.when(F.char_length(message) > 200, F.concat(F.substring(message, 1, 200), F.lit("…"))).otherwise(message)
    at = F.col(line).cast("int") if line else F.lit(None).cast("int")
    region = F.when(at.isNotNull(), F.struct(at.alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return found.select("path", at.alias("line"), F.struct(F.lit(rule).alias("ruleId"), F.lit(level).alias("level"), F.struct(short.alias("text")).alias("message"), F.array(place).alias("locations")).alias("result"))


def _safe(value: Column) -> Column:
    """A value as one part of a path: no separators or control characters, no dots at the ends; 'unknown' if nothing is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(value, r"[/\\\x00-\x1f]", "_"), r"^\.+|\.+$", ""))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("unknown"))


_STAMPS = {"year": "yyyy", "month": "MM", "day": "dd"}


def organize(found: DataFrame, form: str, *, on_conflict: str = "skip") -> DataFrame:
    """(path, target, action): where each file goes under the template *form*, with {token}s.

    Tokens are {basename} {stem} {ext} {dir} {content_type} {size}, {<time>_year},
    _month and _day of a time (mtime is mod_time), and any attribute; a missing
    value is 'unknown'.  Of files with one target the first path takes it; the
    others are skipped, overwrite it in turn, or get ' (1)', ' (2)', ... before
    the ending (*on_conflict* = skip, overwrite, number).
    """
    if on_conflict not in ("skip", "overwrite", "number"):
        raise ValueError(f"unknown conflict policy {on_conflict!r}")
    name = F.element_at(F.split("path", "/"), -1)
    known = {"basename": name, "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "ext": F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1), "dir": F.element_at(F.split("path", "/"), -2)}

    def value(token: str) -> Column:
        if token in known:
            return known[token]
        time, _, unit = token.rpartition("_")
        time = "mod_time" if time == "mtime" else time
        if unit in _STAMPS and time in found.columns:
            return F.date_format(time, _STAMPS[unit])
        if token not in found.columns:
            return F.lit(None).cast("string")
        kind = dict(found.dtypes)[token]
        return F.array_join(F.col(token).cast("array<string>"), "_") if kind.startswith("array") else F.col(token).cast("string")

    parts, at = [], 0
    for m in _TOKEN.finditer(form):
        parts += [F.lit(form[at : m.start()]), _safe(value(m[1]))]
        at = m.end()
    aimed = found.select("path", F.concat(*parts, F.lit(form[at:])).alias("target"))
    nth = F.row_number().over(Window.partitionBy("target").orderBy("path")) - 1
    if on_conflict == "number":
        numbered = F.concat(F.regexp_replace("target", r"(?<=[^/])\.[^./]*$", ""), F.lit(" ("), F.col("nth").cast("string"), F.lit(")"), F.regexp_extract("target", r"(?<=[^/])(\.[^./]*)$", 1))
        return aimed.withColumn("nth", nth).select("path", F.when(F.col("nth") == 0, F.col("target")).otherwise(numbered).alias("target"), F.lit("create").alias("action"))
    later = "skip" if on_conflict == "skip" else "overwrite"
    return aimed.withColumn("nth", nth).select("path", "target", F.when(F.col("nth") == 0, "create").otherwise(later).alias("action"))


def materialize(planned: DataFrame, *, copy: bool = False, overwrite: bool = False) -> DataFrame:
    """(path, target, done): makes the links or copies of organize() where the executors run; done is linked, copied, skipped or failed."""

    def run(batches):
        for pdf in batches:
            done = []
            for source, target, action in zip(pdf["path"], pdf["target"], pdf["action"]):
                try:
                    if action == "skip" or (os.path.lexists(target) and not (overwrite or action == "overwrite")):
                        done.append("skipped")
                        continue
                    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                    if os.path.lexists(target):
                        os.remove(target)
                    shutil.copy2(source, target) if copy else os.symlink(os.path.abspath(source), target)
                    done.append("copied" if copy else "linked")
                except OSError:
                    done.append("failed")
            yield pd.DataFrame({"path": pdf["path"], "target": pdf["target"], "done": done})

    return planned.mapInPandas(run, "path string, target string, done string")
