"""An append-only commit log in which a version belongs to one writer only.

A commit is a small file named by its version that holds what the version is
made of. It is written aside under a name of its own and then takes its place
by a move (on a local disk: a hard link) that fails if the place is taken, the
way Structured Streaming commits its log. So two writers never share a
version, a reader never sees a half-written commit, and a writer that lost
reads the winner's commit and tries again.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

_DIGITS = 10


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _link(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark._jvm
    paths = [jvm.java.io.File(jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()).toPath() for p in (target, source)]
    jvm.java.nio.file.Files.createLink(*paths)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(target)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    context = hadoop.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration())
    # no options: without "overwrite" a rename onto a file fails
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    context.rename(hadoop.Path(source), at, none)


def _move_if_absent(spark: SparkSession, source: str, target: str) -> bool:
    fs, _ = _fs(spark, target)
    try:
        # a local rename looks first and replaces then, which two writers can pass at once; a link cannot
        (_link if fs.getScheme() == "file" else _rename)(spark, source, target)
        return True
    except Exception as e:  # noqa: BLE001 - only "exists" means a lost race
        if "AlreadyExists" in str(e):
            return False
        raise


def commit(spark: SparkSession, log: str, version: int, content: dict[str, Any]) -> bool:
    """Make ``content`` version ``version`` of ``log``; False if another writer has that version."""
    log = log.rstrip("/")
    fs, folder = _fs(spark, log)
    fs.mkdirs(folder)
    aside = f"{log}/.{uuid.uuid4().hex}.tmp"
    _write(spark, aside, json.dumps(content))
    won = _move_if_absent(spark, aside, f"{log}/{version:0{_DIGITS}d}.json")
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), False)
    return won


def newest(spark: SparkSession, log: str) -> tuple[int, dict[str, Any]]:
    """The newest version and its content; (0, {}) before the first."""
    fs, folder = _fs(spark, log.rstrip("/"))
    if not fs.exists(folder):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    versions = [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")]
    if not versions:
        return 0, {}
    return max(versions), at_version(spark, log, max(versions))


def at_version(spark: SparkSession, log: str, version: int) -> dict[str, Any]:
    """Content of one version."""
    fs, at = _fs(spark, f"{log.rstrip('/')}/{version:0{_DIGITS}d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
