"""Results: the keyed store as table operations, and a file sink that never overwrites.

The sink publishes by hard links, so a task that runs twice (a lost executor, speculation) leaves one
file: each result has one staged file, named by job and id, and a target that is the staged file
itself is that result's earlier publication.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import partial
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAVED = "id long, saved_path string, error_code string"


def latest(results: DataFrame) -> DataFrame:
    """K1: of several results (id, seq, ...) of a file the one with the largest seq."""
    rest = [c for c in results.columns if c != "id"]
    return results.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select("id", *(F.col(f"_r.{c}").alias(c) for c in rest))


def without(results: DataFrame, removed: DataFrame) -> DataFrame:
    """K2: the store without the ids of ``removed``."""
    return results.join(removed.select("id").distinct(), "id", "left_anti")


def marked(results: DataFrame, saved: DataFrame) -> DataFrame:
    """K2: ``saved_path`` filled in where ``saved`` has one."""
    paths = saved.where(F.col("saved_path").isNotNull()).groupBy("id").agg(F.max("saved_path").alias("_now"))
    return results.join(paths, "id", "left").withColumn("saved_path", F.coalesce("_now", "saved_path")).drop("_now")


def unsaved_count(results: DataFrame) -> DataFrame:
    """A7"""
    return results.agg(F.count_if(F.col("saved_path").isNull()).alias("unsaved"))


def names(folder: str, name: str) -> Iterator[str]:
    """K6: ``name.ext``, ``name (2).ext``, ``name (3).ext`` ... in ``folder``."""
    stem, ext = os.path.splitext(name)
    yield os.path.join(folder, name)
    for n in count(2):
        yield os.path.join(folder, f"{stem} ({n}){ext}")


def publish(folder: str, name: str, token: str, content: bytes) -> str:
    """K3 K5: ``content`` under the first free name; whole or not at all; the same token twice is one file."""
    staged = os.path.join(folder, f".{token}")
    if not os.path.exists(staged):
        handle, own = tempfile.mkstemp(prefix=f".{token}-", dir=folder)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(own, staged)
            except FileExistsError:
                pass  # another attempt of this task staged it
        finally:
            os.unlink(own)
    for target in names(folder, name):
        try:
            os.link(staged, target)
            return target
        except FileExistsError:
            if os.path.samefile(staged, target):
                return target


def _published(batches: Iterator[pd.DataFrame], folder: str, job: str) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for key, name, content in zip(rows["id"], rows["name"], rows["content"], strict=True):
            if content is None:
                out.append((key, None, "noResult"))
            else:
                try:
                    out.append((key, publish(folder, os.path.basename(name) or "document", f"{job}-{key}", bytes(content)), None))
                except OSError as e:
                    out.append((key, None, f"io: {e.strerror}"))
        yield pd.DataFrame(out, columns=["id", "saved_path", "error_code"])


def save_to_folder(results: DataFrame, folder: str) -> DataFrame:
    """K5: writes every result (id, name, content) into ``folder``, a place that all executors share,
    and returns (id, saved_path, error_code).  Null content is ``noResult``; a failed write is data.

    Runs at once, and once: the outcome is checkpointed (a checkpoint folder must be set), then the
    staged names go."""
    job = f"staged-{uuid.uuid4().hex}"
    out = results.select("id", "name", "content").mapInPandas(partial(_published, folder=folder, job=job), SAVED).checkpoint()
    for name in os.listdir(folder):
        if name.startswith(f".{job}"):
            os.unlink(os.path.join(folder, name))
    return out


def save_as(content: bytes, target: str, originals: DataFrame) -> str | None:
    """One result under a chosen name, which it may replace.  Returns ``sameAsInput``
    and writes nothing where the target is one of ``originals`` (path), by name or by inode."""
    inputs = [r.path for r in originals.select("path").distinct().collect()]  # one scan's files
    if os.path.realpath(target) in map(os.path.realpath, inputs) or any(os.path.exists(target) and os.path.exists(p) and os.path.samefile(p, target) for p in inputs):
        return "sameAsInput"
    folder = os.path.dirname(os.path.abspath(target))
    handle, own = tempfile.mkstemp(prefix=".staged-", dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, target)
    except OSError:
        os.unlink(own)
        raise
    return None
