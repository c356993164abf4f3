"""Folder scan: chosen folders to a table of files in a fixed order, and their contents.

The scan is bounded (depth, entries, files), so it runs in one place: on the driver, or in one task
as the data source ``folder_scan``.  Contents are read by Spark's own reader on the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

#: Folders with these extensions are one document each and are never entered.
PACKAGES = frozenset(
    "app appex band bundle fcpbundle framework imovielibrary key kext logicx musiclibrary numbers pages photoslibrary playground plugin rtfd scptd sparsebundle tvlibrary xcodeproj xcworkspace".split()
)
#: Depth, entries looked at and files taken by one scan.
MAX_DEPTH, MAX_ENTRIES, MAX_FILES = 16, 10_000, 1_000
SCHEMA = "ord long, folder string, path string, name string, extension string, size long"
SUMMARY = "folders int, added int, ignored int, truncated boolean, unreadable array<string>"


class Scan(NamedTuple):
    files: list[tuple]  # rows of SCHEMA
    summary: tuple  # one row of SUMMARY


def extension(name: str) -> str:
    """Letters behind the last dot, in lower case; empty for names such as ``.profile``."""
    return os.path.splitext(name)[1][1:].lower()


def scan(folders: Iterable[str], extensions: Iterable[str], max_depth: int = MAX_DEPTH, max_entries: int = MAX_ENTRIES, max_files: int = MAX_FILES) -> Scan:
    """Files below ``folders`` whose extension is wanted, depth first, names ordered by
    (lower case, name), files and folders mixed.

    Hidden entries are passed over but count as entries; package folders are one ignored file;
    linked files count, linked folders are not followed; a folder is searched once; the first files
    within the limits stay and ``truncated`` says that a limit was met.  A folder that cannot be read
    is named in ``unreadable``; no folders give no files."""
    wanted, files, seen, unreadable = frozenset(e.lower() for e in extensions), [], set(), []
    folders, entries, ignored, truncated = list(folders), 0, 0, False
    for root in folders:
        stack: list[tuple[int, Iterator[os.DirEntry]]] = []
        waiting: tuple[int, str] | None = (0, root)
        while waiting or stack:
            if waiting:
                depth, folder = waiting
                waiting, listed = None, []
                if entries >= max_entries:
                    truncated = True
                    continue
                try:
                    real = os.path.realpath(folder, strict=True)
                    if real in seen:
                        continue
                    seen.add(real)
                    with os.scandir(folder) as found:
                        for entry in found:
                            if entries >= max_entries:
                                truncated = True
                                break
                            entries += 1
                            listed.append(entry)
                except OSError:
                    unreadable.append(folder)
                stack.append((depth, iter(sorted(listed, key=lambda e: (e.name.lower(), e.name)))))
                continue
            depth, rest = stack[-1]
            entry = next(rest, None)
            if entry is None:
                stack.pop()
            elif entry.name.startswith("."):
                continue
            elif entry.is_dir(follow_symlinks=False):
                if extension(entry.name) in PACKAGES:
                    ignored += 1
                elif depth >= max_depth:
                    truncated = True
                else:
                    waiting = (depth + 1, entry.path)
            elif entry.is_file():
                if extension(entry.name) not in wanted:
                    ignored += 1
                elif len(files) >= max_files:
                    truncated = True
                    stack.pop()
                else:
                    files.append((len(files), root, entry.path, entry.name, extension(entry.name), entry.stat().st_size))
    return Scan(files, (len(folders), len(files), ignored, truncated, unreadable))


class FolderScan(DataSource):
    """``spark.read.format("folder_scan").option("extensions", "pdf,png").load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "folder_scan"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderScanReader:
        return FolderScanReader(self.options)


class FolderScanReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder, self.extensions = options.get("path", ""), options.get("extensions", "pdf,jpg,jpeg,png,webp")
        self.limits = [int(options.get(k, d)) for k, d in (("maxDepth", MAX_DEPTH), ("maxEntries", MAX_ENTRIES), ("maxFiles", MAX_FILES))]

    def read(self, partition) -> Iterator[tuple]:
        yield from scan([self.folder], self.extensions.split(","), *self.limits).files


def scanned(spark: SparkSession, folders: Iterable[str], extensions: Iterable[str], **limits: int) -> tuple[DataFrame, DataFrame]:
    """The files and the summary of one scan; at most ``max_files`` rows pass through the driver."""
    found = scan(folders, extensions, **limits)
    return spark.createDataFrame(found.files, SCHEMA), spark.createDataFrame([found.summary], SUMMARY)


def registered(files: DataFrame, scope: str, known: DataFrame | None = None) -> DataFrame:
    """One row for each path and scope with the next ids in scan order; paths that
    ``known`` (id, path, scope) holds keep their ids and are not listed again."""
    new = files.withColumn("scope", F.lit(scope)).groupBy("path", "scope").agg(F.min_by(F.struct("ord", "name", "size"), "ord").alias("f")).select("path", "scope", "f.*")
    start = F.lit(0)
    if known is not None:
        new = new.join(known.select("path", "scope"), ["path", "scope"], "left_anti")
        new, start = new.crossJoin(F.broadcast(known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last")))), F.col("_last")
    # one scan lists at most MAX_FILES files, so one ordered window over it is bounded
    return new.select((F.row_number().over(Window.orderBy("ord")) + start).cast("long").alias("id"), "path", "scope", "name", "size")


def contents(spark: SparkSession, files: DataFrame, limit: int) -> DataFrame:
    """(path, length, content, error_code) of listed files.  Files over ``limit`` bytes are
    refused before their content is touched; exactly ``limit`` is still read.

    The list is that of a scan, so its paths fit the driver."""
    paths = [r.path for r in files.select("path").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "path string, length long, content binary, error_code string")
    read = spark.read.format("binaryFile").load([f"file://{_quoted(p)}" for p in paths])
    taken = read.where(F.col("length") <= limit).select("path", "length", "content", F.lit(None).cast("string").alias("error_code"))
    refused = read.where(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("tooLarge").alias("error_code"))
    return taken.unionByName(refused).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))


def _quoted(path: str) -> str:
    """Glob signs of a name stand for themselves."""
    return "".join(f"\\{c}" if c in "\\{}[]*?" else c for c in os.path.abspath(path))


def picked(paths: Iterable[str], extensions: Iterable[str], scope: str) -> list[tuple[str, str, str, int | None]]:
    """(outcome, name, path, size) of chosen or dropped paths: files are taken as they are, folders
    are searched for ``extensions``; what cannot be read, dropped packages and unreadable folders are ``skipped``."""
    out, folders = [], []
    for path in paths:
        if os.path.isdir(path) and extension(path) not in PACKAGES:
            folders.append(path)
        elif os.path.isfile(path) and os.access(path, os.R_OK):
            out.append(("added", os.path.basename(path), path, os.path.getsize(path)))
        else:
            out.append(("skipped", os.path.basename(path.rstrip("/")), path, None))
    if folders:
        found = scan(folders, extensions)
        out += [("added", f[3], f[2], f[5]) for f in found.files] + [("skipped", os.path.basename(p), p, None) for p in found.summary[4]]
    seen: set[str] = set()
    return [r for r in out if not (r[2] in seen or seen.add(r[2]))]


def arriving(spark: SparkSession, folder: str, extensions: Iterable[str], limit: int, active: str | None = None) -> DataFrame:
    """Files that come into a folder, as a stream of (path, name, size, scope, content); files of other
    kinds and hidden ones are passed over, those over ``limit`` bytes come without content.  ``active``: the tool
    that takes them, which becomes their scope."""
    wanted = "|".join(sorted(e.lower() for e in extensions))
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(F.lower(name).rlike(rf"[.]({wanted})$") & ~name.startswith("."))
    return kept.select("path", name.alias("name"), F.col("length").alias("size"), F.lit(active).alias("scope"), F.when(F.col("length") <= limit, F.col("content")).alias("content"))
