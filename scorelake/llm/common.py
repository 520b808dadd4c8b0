"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table; others are never read, so their names cannot clash."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: Rows and bytes of an Arrow batch. Rows here are whole texts; the defaults of 10,000 and 64 MB would let a few very long
#: texts, held as Arrow, Python and results at once, take hundreds of MB of a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="shared-")
    return own


#: Folders of the tables written and not yet discarded, oldest first.
kept: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more; other frames are left alone."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            discard_paths(t.sparkSession, [path])


def discard_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in list(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in kept:
            kept.remove(path)


#: Bytes of lower-cased ASCII letters, digits and everything beyond ASCII; the rest become spaces.
WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The same with digits as spaces.
LETTER_BYTES = bytes(32 if 48 <= c <= 57 else WORD_BYTES[c] for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: A-Z lower-cased, cut at ASCII characters that are neither letters nor digits. None has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []
