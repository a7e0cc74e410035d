"""Batches of partitioned text files that are seen whole, once, or not at all.

A batch is written to a folder of its own first. Then a small commit file is put beside the
others in one rename; it names the batch, its folder and the logs in it. Readers look at nothing
that no commit names, so a writer that dies leaves no trace, and a batch that is tried again under
the same id is left alone. A replacing batch hides what earlier batches hold of the logs in it.

Commits are one small file a batch; ``compact`` makes one batch of all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import file_exists, file_system

COMMIT = "sequence long, batch string, folder string, logs array<string>, replaces boolean"


def commits(spark: SparkSession, folder: str) -> list[dict]:
    """The committed batches of a folder in their order."""
    if not file_exists(spark, f"{folder}/commits"):
        return []
    found = [r.asDict() for r in spark.read.schema(COMMIT).json(f"{folder}/commits").collect()]
    return sorted(found, key=lambda c: (c["sequence"], c["batch"]))


def is_committed(spark: SparkSession, folder: str, batch: str) -> bool:
    return any(c["batch"] == batch for c in commits(spark, folder))


def write_batch(
    rows: DataFrame, folder: str, partition: str, batch: str | None = None, replaces: bool = False
) -> bool:
    """Write ``rows`` (one text column besides the partition) as one batch.

    Returns False, having written nothing, if a batch of that id is committed already.
    """
    spark, batch = rows.sparkSession, batch or uuid.uuid4().hex
    earlier = commits(spark, folder)
    if any(c["batch"] == batch for c in earlier):
        return False
    attempt = f"batch={quote(batch, safe='')}-{uuid.uuid4().hex}"
    rows.write.partitionBy(partition).text(f"{folder}/batches/{attempt}")
    path, files = file_system(spark, f"{folder}/batches/{attempt}")
    names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
    commit = {
        "sequence": max((c["sequence"] for c in earlier), default=0) + 1,
        "batch": batch,
        "folder": attempt,
        "logs": sorted(n for n in names if n.startswith(f"{partition}=")),
        "replaces": replaces,
    }
    _put(spark, f"{folder}/commits", f"{commit['sequence']:010d}-{uuid.uuid4().hex}.json", commit)
    return True


def _put(spark: SparkSession, folder: str, name: str, content: dict) -> None:
    """Create a file with its whole content at once: written under a hidden name, then renamed."""
    hidden, files = file_system(spark, f"{folder}/.{name}")
    out = files.create(hidden, False)
    try:
        out.write(bytearray((json.dumps(content) + "\n").encode()))
    finally:
        out.close()
    if not files.rename(hidden, file_system(spark, f"{folder}/{name}")[0]):
        raise OSError(f"cannot commit {folder}/{name}")


def live_folders(found: Sequence[dict]) -> list[str]:
    """Partition folders that readers see: of each log, those since the last batch that replaced it."""
    since: dict[str, int] = {}
    for place, commit in enumerate(found):
        if commit["replaces"]:
            since |= dict.fromkeys(commit["logs"], place)
    return [
        f"{commit['folder']}/{log}"
        for place, commit in enumerate(found)
        for log in commit["logs"]
        if place >= since.get(log, 0)
    ]


def read_folders(spark: SparkSession, folder: str, partition: str, paths: Sequence[str]) -> DataFrame:
    """``value`` and the partition column of some partition folders."""
    if not paths:
        return spark.createDataFrame([], f"value string, {partition} string")
    base = f"{folder}/batches"
    rows = spark.read.schema(f"value string, batch string, {partition} string").option("basePath", base)
    return rows.text([f"{base}/{path}" for path in paths]).select("value", partition)


def read_batches(spark: SparkSession, folder: str, partition: str) -> DataFrame:
    """``value`` and the partition column of all rows that are committed and not replaced."""
    return read_folders(spark, folder, partition, live_folders(commits(spark, folder)))


def compact(spark: SparkSession, folder: str, partition: str) -> bool:
    """Write everything that is live as one batch that replaces all logs in it."""
    if len(live_folders(commits(spark, folder))) < 2:
        return False
    return write_batch(read_batches(spark, folder, partition), folder, partition, replaces=True)


def remove_hidden(spark: SparkSession, folder: str) -> int:
    """Delete partition folders that no reader sees any more; not while another writer is at work."""
    path, files = file_system(spark, f"{folder}/batches")
    live, removed = set(live_folders(commits(spark, folder))), 0
    for batch in files.listStatus(path) if files.exists(path) else ():
        for log in files.listStatus(batch.getPath()):
            name = f"{batch.getPath().getName()}/{log.getPath().getName()}"
            if log.isDirectory() and name not in live:
                removed += bool(files.delete(log.getPath(), True))
    return removed
