"""Shared scratch tables.

Lineage is cut by writing a table under ``spark.checkpoint.dir``, the folder that
driver and executors share; a lost executor then costs a re-read, not a re-run.
Only where that setting is absent and the master is local (tests on one machine) a temporary
folder is set; on a cluster its absence is an error, as a folder of one machine would lose rows.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one is set if none is."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = getattr(spark.sparkContext, "_tidewright_dir", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="tidewright-")
            spark.sparkContext.setCheckpointDir(named)
            spark.sparkContext._tidewright_dir = named
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewright_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing will read them again."""
    for table in tables:
        spark, path = table.sparkSession, table._tidewright_path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver's cleaner remove shuffle files of plans that are no longer referenced.

    The session holds on to the last query it ran, so a query of one row runs first."""
    import gc

    spark.range(1).collect()
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) for the jobs run inside."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks column(s) {missing}")


def held_out(doc_id, modulus: int):
    """True where crc32 of the id written as text leaves 1; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 1, F.lit(False))
