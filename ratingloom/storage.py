"""Folders that change in one step: what a writer has not finished is never read.

Files go where no reader looks yet; one small file, created last, publishes them. Creating a file is a single
step on every file system that Spark writes to, renaming a folder is not.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from ratingloom.session import delete_folder

MANIFEST = "manifest.json"


def _files_at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def make_folder(spark: SparkSession, path: str) -> None:
    files, folder = _files_at(spark, path)
    files.mkdirs(folder)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none where there is no folder."""
    files, folder = _files_at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []


def create_file(spark: SparkSession, path: str, text: str = "") -> None:
    """A new file of plain ASCII; an error if there is one."""
    files, file = _files_at(spark, path)
    out = files.create(file, False)
    out.writeBytes(text)
    out.close()


def _sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of every file below a folder, by its path in there."""
    files, folder = _files_at(spark, path)
    start, found, walk = len(files.makeQualified(folder).toString()) + 1, {}, files.listFiles(folder, True)
    while walk.hasNext():
        status = walk.next()
        found[status.getPath().toString()[start:]] = status.getLen()
    found.pop(MANIFEST, None)
    return found


def save_version(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Let ``write`` fill a new version of the folder ``path``, then publish it; returns where it is.

    Until then, and if ``write`` fails, readers get the version before. The last ``keep`` published versions
    stay, so that who reads the one before can finish.
    """
    numbers = [int(n.split("-")[1]) for n in names_in(spark, path) if n.startswith("version-")]
    version = f"{path}/version-{max(numbers, default=0) + 1:09d}-{uuid.uuid4().hex}"
    write(version)
    create_file(spark, f"{version}/{MANIFEST}", json.dumps(_sizes(spark, version)))
    for name in _published(spark, path)[:-keep]:
        delete_folder(spark, f"{path}/{name}")
    return version


def _published(spark: SparkSession, path: str) -> list[str]:
    names = [n for n in names_in(spark, path) if n.startswith("version-")]
    return [n for n in names if MANIFEST in names_in(spark, f"{path}/{n}")]


def current_version(spark: SparkSession, path: str) -> str:
    """Where the last published version of a folder is; an error if files of it are missing or cut."""
    published = _published(spark, path)
    if not published:
        raise FileNotFoundError(f"nothing has been published in {path}")
    version = f"{path}/{published[-1]}"
    wanted = json.loads(spark.read.text(f"{version}/{MANIFEST}", wholetext=True).first()[0])
    found = _sizes(spark, version)
    damaged = sorted(f for f, size in wanted.items() if found.get(f) != size)
    if damaged:
        raise ValueError(f"{version} is damaged: {len(damaged)} files are missing or cut, the first is {damaged[0]}")
    return version
