"""Files as rows: which there are, where they stand, and whether they are whole.

The source lists names on the driver; what is in a file is read on executors, one partition a file, in pieces. Both must
see the folder (a mounted or shared one).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 1 << 20


class FilePartition(InputPartition):
    def __init__(self, path: str, level: int):
        self.path, self.level = path, level


def listed(folder: str, level: str = "1", match: Sequence[str] = ()) -> list[tuple[str, int]]:
    """(path, level) of files, sorted. level: "2" takes files two folders deep, "3+" those of the first three levels, "+" all.

    Each of ``match`` must be part of the path (as it was given, with the folder); after "!" it must not be.
    """
    most = None if level == "+" else int(level.rstrip("+"))
    if most is not None and most < 1:
        raise ValueError("level begins at 1")
    out = []
    for base, _, names in os.walk(folder):
        depth = 1 if os.path.samefile(base, folder) else 1 + len(os.path.relpath(base, folder).split(os.sep))
        if most is None or (depth <= most if level.endswith("+") else depth == most):
            out += [(os.path.join(base, name), depth) for name in names]
    return sorted((p, d) for p, d in out if all((m[1:] not in p) if m.startswith("!") else (m in p) for m in match if m))


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[FilePartition]:
        folder = self.options.get("path")
        if not folder:
            raise ValueError("path is missing")
        folder = folder.removeprefix("file://")
        if not os.path.isdir(folder):
            raise FileNotFoundError(folder)
        match = [m for m in self.options.get("match", "").split(",") if m]
        return [FilePartition(p, d) for p, d in listed(folder, self.options.get("level", "1"), match)] or [FilePartition("", 0)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if not partition.path:
            return
        digest, size = hashlib.new(self.options.get("digest", "md5")), 0
        with open(partition.path, "rb") as f:
            while piece := f.read(PIECE):
                digest.update(piece)
                size += len(piece)
        folder, name = os.path.split(partition.path)
        modified = datetime.fromtimestamp(os.path.getmtime(partition.path), UTC)
        yield partition.path, name, os.path.splitext(name)[0], os.path.basename(folder), partition.level, size, modified, digest.hexdigest()


class FileSource(DataSource):
    """Format ``scorelake_files``. Options: path, level, match (separated by commas), digest (md5 unless another is named)."""

    @classmethod
    def name(cls) -> str:
        return "scorelake_files"

    def schema(self) -> str:
        return "path string, name string, stem string, category string, level int, size long, modified timestamp, digest string"

    def reader(self, schema) -> FileReader:
        return FileReader({k.lower(): v for k, v in self.options.items()})


def files(spark: SparkSession, path: str, level: str = "1", match: Sequence[str] = (), digest: str = "md5") -> DataFrame:
    """A row for each file of a folder: path, name, stem, category (its folder's name), level, size, modified, digest."""
    if any("," in m for m in match):
        raise ValueError("a pattern has a comma")
    spark.dataSource.register(FileSource)
    return spark.read.format(FileSource.name()).options(path=path, level=level, match=",".join(match), digest=digest).load()


def intact(found: DataFrame, known: DataFrame) -> DataFrame:
    """known (name, digest) with state: ``intact``, ``changed`` or ``missing``, and the paths that are intact. Files without a known digest
    do not come; of files of one name one intact one is enough. Digests are compared without case."""
    each = found.select("name", F.col("path").alias("__path"), F.lower("digest").alias("__found"))
    k = known.select("name", "digest").distinct()
    same = F.col("__found") == F.lower(F.col("digest"))
    state = F.when(F.max(same), "intact").when(F.count("__path") > 0, "changed").otherwise("missing")
    return k.join(each, "name", "left").groupBy("name", "digest").agg(state.alias("state"), F.sort_array(F.collect_list(F.when(same, F.col("__path")))).alias("paths"))


def folder_of(level: int = 1) -> Column:
    """Name of the folder that a row's file stands in (level 1), or of one further up; for frames read from files."""
    return F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -1 - level)


def categorised(spark: SparkSession, path: str, fmt: str = "parquet", name: str = "category") -> DataFrame:
    """All files below a folder as one table, each row with the name of its file's folder."""
    df = spark.read.option("recursiveFileLookup", True).format(fmt).load(path)
    return df.withColumn(name, folder_of())


def pointed(rows: DataFrame, found: DataFrame, key: str, name: str = "file", suffix: str = "", without: str | None = None) -> DataFrame:
    """rows with the first path whose stem is the row's key, of files with that suffix and without that part in the path; null if there is none."""
    fits = F.col("name").endswith(suffix)
    if without:
        fits &= ~F.contains("path", F.lit(without))
    first = found.where(fits).groupBy(F.col("stem").alias("__stem")).agg(F.min("path").alias(name))
    return rows.join(first, F.col(key).cast("string") == F.col("__stem"), "left").drop("__stem")
