"""Intermediate tables in the folder that the whole cluster shares.

A table written here cuts the lineage: a lost executor costs a re-read, not a
recomputation.  The folder is the session's ``spark.checkpoint.dir``; only where
that is unset and the master is local (tests, a laptop) one is made under the local temp folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_TAG = [""]


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="arbora-")
    return _LOCAL["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/arbora-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(_TAG[0], []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings for what is planned inside; those of before come back."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def drop(spark: SparkSession, tag: str = "") -> None:
    """Delete the intermediate tables written under ``tag``; their readers must be done."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(tag, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def begin(spark: SparkSession, tag: str) -> None:
    """What ``tag`` wrote before goes; what is written from now on belongs to it."""
    drop(spark, tag)
    _TAG[0] = tag


def end() -> None:
    """What is written from now on belongs to no tag."""
    _TAG[0] = ""
