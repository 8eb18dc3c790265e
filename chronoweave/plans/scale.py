"""Helpers that keep plans sound at scale: checked broadcasts, checkpoints, Arrow streaming."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was brought to the driver and has at most so many rows and bytes there.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persists an intermediate frame that a lazy result still needs; `release` frees all of them."""
    _KEPT.append(df.persist())
    return _KEPT[-1]


def release() -> None:
    """Frees what the operators have kept so far, and removes their intermediate files. Results that were not used yet and read
    kept frames stay right, they compute them again; those that read files must have been used."""
    while _KEPT:
        df = _KEPT.pop()
        if df.sparkSession.sparkContext._jsc is not None:
            df.unpersist()
    while _FOLDERS:
        spark, folder = _FOLDERS.pop()
        if spark.sparkContext._jsc is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size, from the sizes of its files; nothing is run. Unknown sizes are huge."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def settled(small: DataFrame) -> tuple[DataFrame, bool]:
    """A small frame as a local table, which cuts its lineage, and whether it was small; else the frame as it is."""
    held = small.limit(BROADCAST_ROWS + 1).toArrow()
    if held.num_rows > BROADCAST_ROWS or held.nbytes > BROADCAST_BYTES:
        return small, False
    return small.sparkSession.createDataFrame(held, small.schema), True


def sized_broadcast(small: DataFrame) -> DataFrame:
    """A broadcast of `small` if its rows and bytes were measured to be few, else the join is left to Catalyst."""
    held, fits = settled(small)
    return F.broadcast(held) if fits else held


def cut(df: DataFrame) -> DataFrame:
    """A frame that is used several times, written to the shared checkpoint folder; its plan ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a folder of our own only where that is unset and Spark is local."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or (sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
        folder = os.path.join(tempfile.gettempdir(), "chronoweave-checkpoints")
        sc.setCheckpointDir(folder)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


_FOLDERS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files in the shared folder; `release` removes it."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, folder))
    return folder


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Regroup the batches of a partition that is sorted by `keys`, so that no group is split between two frames.

    A frame holds about `rows` rows; more only where one group has more. Every row is copied once.
    """
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if batch.empty:
            continue
        # rows of the batch that share the key of its last one; they are its end
        tail = batch[keys].iloc[-1]
        same = np.ones(len(batch), bool)
        for k in keys:
            same &= (batch[k].isna() if pd.isna(tail[k]) else batch[k] == tail[k]).to_numpy()
        cut = len(batch) - int(same.sum())
        if n + cut < rows or (cut == 0 and _ends_with(held, tail, keys)):
            held.append(batch)
            n += len(batch)
            continue
        if cut:
            held.append(batch.iloc[:cut])
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        held, n = [batch.iloc[cut:].reset_index(drop=True)], len(batch) - cut
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def _ends_with(held: list[pd.DataFrame], key: pd.Series, keys: list[str]) -> bool:
    """Whether the last row held has a key; rows of one key are never told apart."""
    if not held:
        return True
    last = held[-1][keys].iloc[-1]
    return all((pd.isna(last[k]) and pd.isna(key[k])) or last[k] == key[k] for k in keys)


def arrow_rows(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of numpy arrays or lists."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
