"""Stored tables that are replaced in one step and found again by later sessions.

A table is a folder. Each load writes a new version folder in it and then publishes a small
manifest that names the version and what it was made from. Readers take the newest manifest:
until it is published they see the old rows, afterwards the new ones, and a reader that has
begun goes on reading its own version. A load that dies leaves a folder that nobody reads.
A manifest is written under another name and renamed, so it is never seen half written; the
rename fails if a load of the same number was quicker, and the next number is tried.

All calls go through Hadoop's file systems, so any store that Spark reads will do, and their
number does not depend on the number of files.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from revlens.session import shuffles_deleted

_MANIFESTS = "_manifests"


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def signature(spark: SparkSession, *paths: str) -> str:
    """Digest of the paths with their numbers of files, bytes and last change: three calls a path.

    A file that is added, removed or rewritten changes its folder's time, its count or its bytes.
    """
    seen = []
    for path in paths:
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            seen.append((path,))
            continue
        held = fs.getContentSummary(p)
        seen.append((path, held.getFileCount(), held.getLength(), fs.getFileStatus(p).getModificationTime()))
    return hashlib.md5(repr(seen).encode()).hexdigest()


def _numbers(fs, folder) -> list[int]:
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())


def current(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest of the table at ``root``, with its number; None if nothing was published."""
    fs, folder = _fs(spark, f"{root}/{_MANIFESTS}")
    if not fs.exists(folder):
        return None
    numbers = _numbers(fs, folder)
    if not numbers:
        return None
    jvm = spark.sparkContext._jvm
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, str(numbers[-1])))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": numbers[-1]}
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, manifest: dict) -> dict:
    """Make ``manifest`` the newest of the table at ``root``."""
    fs, folder = _fs(spark, f"{root}/{_MANIFESTS}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(folder)
    draft = path(folder, f"_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    number = max(_numbers(fs, folder), default=0) + 1
    while fs.exists(path(folder, str(number))) or not fs.rename(draft, path(folder, str(number))):
        number += 1
    return manifest | {"number": number}


def replace(df: DataFrame, root: str, source: str, **options: str) -> str:
    """Write ``df`` as a new version of the table at ``root`` and switch to it; return the version's folder.

    ``options`` are those of the Parquet writer. Shuffle files of the write are deleted with it."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    with shuffles_deleted(df.sparkSession):
        df.write.mode("errorifexists").options(**options).parquet(path)
    publish(df.sparkSession, root, {"path": path, "source": source})
    return path


def find(spark: SparkSession, root: str, source: str) -> str | None:
    """Folder of the newest version, if it was made from ``source``."""
    manifest = current(spark, root)
    return manifest["path"] if manifest and manifest["source"] == source else None


def prune(spark: SparkSession, root: str) -> int:
    """Delete all versions but the newest published one, and the older manifests; return how many folders went.

    Call it when no job reads an older version any more.
    """
    manifest = current(spark, root)
    fs, folder = _fs(spark, root)
    if manifest is None or not fs.exists(folder):
        return 0
    keep = {manifest["path"].rsplit("/", 1)[1], *(p.rsplit("/", 1)[1] for p in manifest.get("parts", [])), _MANIFESTS}
    gone = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in keep]
    for p in gone:
        fs.delete(p, True)
    _, notes = _fs(spark, f"{root}/{_MANIFESTS}")
    for f in fs.listStatus(notes):
        if f.getPath().getName() != str(manifest["number"]):
            fs.delete(f.getPath(), True)
    return len(gone)


def drop(spark: SparkSession, root: str) -> None:
    """Delete the table at ``root`` with all its versions."""
    fs, folder = _fs(spark, root)
    fs.delete(folder, True)
