"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept. ``lower`` is the fast way and equals that on ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where none is set and all runs in one process (tests) a temporary one."""
    sc = spark.sparkContext
    if (found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()) is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that all of them see")
        found = tempfile.mkdtemp("-checkpoints")
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table to the shared folder, with its lineage cut."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes checkpointed tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def session_conf(spark: SparkSession, **settings: object) -> Iterator[None]:
    """Settings (dots as ``__``) that hold while the jobs inside run."""
    before = {k: spark.conf.get(k, None) for k in (x.replace("__", ".") for x in settings)}
    try:
        for k, v in settings.items():
            spark.conf.set(k.replace("__", "."), str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
