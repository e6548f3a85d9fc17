"""A log of commits in a shared folder: numbered files, each claimed by exactly one writer.

Rows are written to a folder of their own first; then the next number is claimed by a small file
that names the folder. Readers see only folders that the log names, so what a failed or beaten
writer leaves behind is never read, and a number is never used twice.

    root/log/00000000000000000007.json    {"version": 7, "folder": "w-3f...", "at": "..."}
    root/data/folder=w-3f.../...          rows

A claim must fail where the file exists. On local paths a hard link does that, elsewhere a
rename that does not replace, as HDFS gives. Object stores whose rename replaces are
not safe with several writers.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = "version long, folder string, at string"
#: Claims lost in a row before a writer gives up.
ATTEMPTS = 50


class CommitConflict(RuntimeError):
    """Another writer committed first."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _log(root: str) -> str:
    return f"{root.rstrip('/')}/log"


def log_entries(spark: SparkSession, root: str) -> DataFrame:
    """(version, folder, at) of all commits; no rows where there is no log yet."""
    fs, place = _hadoop(spark, _log(root))
    if not fs.exists(place):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).json(_log(root))


def last_version(spark: SparkSession, root: str) -> int:
    """The number of the newest commit, 0 before the first."""
    fs, place = _hadoop(spark, _log(root))
    if not fs.exists(place):
        return 0
    # Names only: a claim is whole once its name is there.
    names = (s.getPath().getName() for s in fs.listStatus(place))
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def claim(spark: SparkSession, root: str, version: int, folder: str) -> bool:
    """Write the commit of ``version`` unless it exists; True if it is now ours. The file is written
    under a hidden name first, so that it is whole when its name appears."""
    fs, place = _hadoop(spark, _log(root))
    fs.mkdirs(place)
    text = json.dumps({"version": version, "folder": folder, "at": datetime.now(timezone.utc).isoformat()})
    name, hidden = f"{version:020d}.json", f".{uuid.uuid4().hex}.tmp"
    qualified = fs.makeQualified(place).toUri()
    if qualified.getScheme() == "file":
        local = qualified.getPath()
        with open(f"{local}/{hidden}", "w") as f:
            f.write(text)
        try:
            os.link(f"{local}/{hidden}", f"{local}/{name}")
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{local}/{hidden}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    source, target = path(place, hidden), path(place, name)
    stream = fs.create(source, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    won = not fs.exists(target) and fs.rename(source, target)
    if not won:
        fs.delete(source, False)
    return won


def new_folder() -> str:
    return f"w-{uuid.uuid4().hex}"


def read_rows(spark: SparkSession, root: str, after: int = 0, upto: int | None = None) -> DataFrame | None:
    """Rows of the commits after one version up to another; None before the first commit. The
    log is joined to the folder column, so nothing is gathered and unnamed folders are
    pruned."""
    entries = log_entries(spark, root).filter(F.col("version") > after)
    if upto is not None:
        entries = entries.filter(F.col("version") <= upto)
    if entries.isEmpty():
        return None
    return spark.read.parquet(f"{root.rstrip('/')}/data").join(entries.select("folder"), "folder", "left_semi").drop("folder")


def append(spark: SparkSession, root: str, rows: DataFrame, against: Callable[[DataFrame, DataFrame], DataFrame]) -> int | None:
    """Append rows that must agree with all that is there. ``against(existing, rows)`` gives the rows
    that may still be appended. It is called with all committed rows, and after each lost claim
    once more with the rows that were committed in between, so that whatever
    order the writers end up in, each has been held against all before it. Gives the version,
    None where nothing was left to append."""
    base = f"{root.rstrip('/')}/data"
    seen = last_version(spark, root)
    existing = read_rows(spark, root, 0, seen)
    left = rows if existing is None else against(existing, rows)
    for _ in range(ATTEMPTS):
        folder = new_folder()
        written = f"{base}/folder={folder}"
        left.write.mode("error").parquet(written)
        left = spark.read.parquet(written)
        if left.isEmpty():
            return None
        # What was committed while these rows were written.
        newest = last_version(spark, root)
        if newest == seen and claim(spark, root, seen + 1, folder):
            return seen + 1
        newest = last_version(spark, root)
        since = read_rows(spark, root, seen, newest)
        left, seen = against(since, left), newest
    raise CommitConflict(f"{ATTEMPTS} claims lost under {root}")
