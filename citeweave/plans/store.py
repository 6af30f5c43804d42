"""Tables between the stages of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where tables are put over those of the run before, and how many this run has put there; unset: each in a place of its own.
_SLOTS: ContextVar[list | None] = ContextVar("slots", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the setting is missing, local mode takes a folder of its own; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_citeweave_stages", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark._citeweave_stages = "file://" + tempfile.mkdtemp(prefix="citeweave-")
    return folder


@contextmanager
def slots(folder: str) -> Iterator[None]:
    """Within, `kept` writes its tables one by one to numbered places of a folder, over what a run before has left there.

    So runs that follow each other take the room of one. What a run returns must be written before the next begins."""
    token = _SLOTS.set([folder, 0])
    try:
        yield
    finally:
        _SLOTS.reset(token)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table under the shared folder: what follows is planned from a scan and survives lost executors."""
    spark = df.sparkSession
    slot = _SLOTS.get()
    if slot:
        path = f"{slot[0]}/{slot[1]:03d}"
        slot[1] += 1
    else:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
