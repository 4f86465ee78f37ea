"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest table (rows times bytes of a row) that an operator hands to broadcast().
BROADCAST_BYTES = 64 << 20

_used: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if the master is local;
    on a cluster a folder of this machine's would be shared by nobody, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="umbra-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/umbra-{spark.sparkContext.applicationId}"
    _used[path] = (spark, path)
    return path



def clear_scratch() -> None:
    """Delete what this process wrote to the shared folder; results built on it can't be read afterwards."""
    for spark, path in list(_used.values()):
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM is gone; whoever owns the shared folder empties it
            break
    _used.clear()


atexit.register(clear_scratch)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch: texts may be long, and a Python worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends at most BATCH_ROWS rows and about BATCH_BYTES at a time to Python workers."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = str(conf.get(key)).lower().removesuffix("b")
        if not (held.isdigit() and 0 < int(held) <= most):
            conf.set(key, str(most))
    return df


#: Seconds without use after which a worker drops what is kept.
IDLE = 5.0
_lock = threading.Lock()
_seen = {"operator": "", "at": 0.0, "watched": 0, "trimmed": True}


class Kept(dict):
    """What a module keeps in a Python worker for its next batches, by key: one value at a time, until it is idle."""

    all: list[Kept] = []

    def __init__(self) -> None:
        super().__init__()
        self.at = 0.0
        Kept.all.append(self)

    def value(self, key: object, make: Callable[[], object]) -> object:
        with _lock:
            found = self.get(key)
            if found is None:
                self.clear()
                found = self[key] = make()
            self.at = time.monotonic()
            return found


def _drop_idle() -> None:
    """What nobody used for a while goes, and allocators give back the memory that they hold on to."""
    with _lock:
        for kept in Kept.all:
            if kept and time.monotonic() - kept.at > IDLE:
                kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator gives memory back as it sees fit
        pass


def _watch() -> None:
    """Workers outlive stages, and one that has no task gets no batch that would tell it so."""
    while True:
        time.sleep(IDLE)
        if not _seen["trimmed"] and time.monotonic() - _seen["at"] > IDLE:
            _seen["trimmed"] = True
            _drop_idle()


def enter(operator: str) -> None:
    """Called by an operator for each batch in a Python worker. What stages of several operators keep would add up there: it goes
    when another operator comes, and when none comes for a while."""
    before, _seen["operator"] = _seen["operator"], operator
    _seen["at"], _seen["trimmed"] = time.monotonic(), False
    if _seen["watched"] != os.getpid():
        _seen["watched"] = os.getpid()
        threading.Thread(target=_watch, daemon=True).start()
    if before != operator:
        _drop_idle()


def crc32_of_id(col: str | Column) -> Column:
    """crc32 of the id as text; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("null")).cast("string").cast("binary"))


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over edges (a, b)."""
    label = np.arange(n)
    if not len(a):
        return label
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        if (label == before).all():
            return label
