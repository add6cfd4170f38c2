"""Git history as a table: one row a path, from one log per repository."""

from __future__ import annotations

import subprocess
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

LOG = "path string, last_commit_time timestamp_ntz, last_author string, last_subject string, first_seen timestamp_ntz, commit_count bigint"
#: Fields of a commit's line, which begins with a mark that no path has.
_MARK, _PART = "\x01", "\x02"
FORMAT = f"{_MARK}%ct{_PART}%an{_PART}%s"


def parse_log(lines, root: str) -> list[tuple]:
    """LOG rows of the lines of ``git log --format=FORMAT --name-only``, newest commit first."""
    found: dict[str, list] = {}
    when = author = subject = None
    for line in lines:
        line = line.rstrip("\n")
        if line.startswith(_MARK):
            stamp, author, subject = line[1:].split(_PART, 2)
            when = datetime.fromtimestamp(int(stamp), timezone.utc).replace(tzinfo=None)
        elif line:
            path = f"{root}/{line}"
            if path in found:
                found[path][4:] = [when, found[path][5] + 1]
            else:
                found[path] = [path, when, author, subject, when, 1]
    return [tuple(x) for x in found.values()]


def _run(batches):
    names = [x.split()[0] for x in LOG.split(", ")]
    for pdf in batches:
        for root in pdf["root"]:
            command = ["git", "-C", root, "-c", "core.quotePath=false", "-c", "safe.directory=*", "log", f"--format={FORMAT}", "--name-only", "--no-renames"]
            try:
                with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as p:
                    rows = parse_log(p.stdout, root)
            except OSError:
                rows = []
            yield pd.DataFrame(rows, columns=names)


def git_log(spark: SparkSession, *roots: str) -> DataFrame:
    """LOG of the repositories at *roots*, read where the executors run; a folder that is no repository has no rows.

    Times are in UTC.  Join it to files by path with stats.with_git().
    """
    rows = spark.createDataFrame([(r.rstrip("/"),) for r in roots], "root string").repartition(max(len(roots), 1))
    return rows.mapInPandas(_run, LOG)
