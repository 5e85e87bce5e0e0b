"""Helpers that all training-data operators share: scratch tables in the folder
the cluster names in ``spark.checkpoint.dir``, and the word pattern."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="chiweave-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends at the latest."""
    path = f"{shared_dir(spark)}/chiweave/{uuid.uuid4().hex[:12]}-{name}"
    _scratch.append((spark, path))
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that nothing will read again."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _scratch[:] = [x for x in _scratch if x[1] != path]


def mark() -> int:
    """Where the list of scratch tables ends now; for ``discard_since``."""
    return len(_scratch)


def discard_since(spark: SparkSession, at: int, *keep: str) -> None:
    """Deletes the scratch tables made since ``mark`` gave ``at``, but for ``keep``."""
    discard(spark, *(path for _, path in _scratch[at:] if path not in keep))


def table(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and
    what is read again is what an executor lost later cannot take along."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can: after
    work in numpy on the driver it would else stay with the process through later stages."""
    gc.collect()
    trim()


def trim() -> None:
    """Returns freed memory to the system, without a collection: cheap enough for each task
    to end with, so that a worker that waits for its next stage holds only its caches."""
    back = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if back is not None:
        back(0)


def let_go(spark: SparkSession) -> None:
    """Frees what a finished stage left on the driver: Python lets go of its plans, and the
    JVM's collection finds them, with the broadcasts and shuffle files that Spark's cleaner
    drops only once they are found (Spark asks for one by itself every 30 minutes)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def skewed_join(big: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """The inner join of ``big`` (``total`` rows) with ``small``, which has a row per key
    and in ``weight`` how many rows of ``big`` have it. Keys with a thousandth of all rows
    and more, fewer than a thousand by that, are broadcast, so their rows stay where they
    are; the others are shuffled. (Below 100,000 rows: keys with more than 100.)"""
    limit = max(100, total // 1000)
    hot, rest = small.filter(F.col("weight") > limit).drop("weight"), small.filter(F.col("weight") <= limit).drop("weight")
    if not hot.limit(1).count():
        return big.join(rest, key)
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return big.join(F.broadcast(hot), key).unionByName(cold)


_clear: dict[str, object] = {}  # a worker's caches, by owner


def only_cache(owner: str, clear) -> None:
    """Called where a task of ``owner`` begins: empties what other operators keep in
    this worker process, so that stages of one job do not add up, and gives it back."""
    others = [other for other in _clear if other != owner]
    for other in others:
        _clear.pop(other)()
    if others:
        give_back()
    _clear[owner] = clear


class WordHashes(dict):
    """Hashes of words (bytes), at most ``most`` of them kept."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)


_POWERS = (np.random.default_rng(21).integers(1, 1 << 63, 16, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def run_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, given the words' own; none if there are fewer."""
    m = len(w) - k + 1
    if m < 1:
        return w[:0]
    s = np.full(m, k, np.uint64)
    for j in range(k):
        s += w[j : m + j] * _POWERS[j % len(_POWERS)] + (s << np.uint64(7) if j >= len(_POWERS) else np.uint64(0))
    s ^= s >> np.uint64(29)
    s *= np.uint64(0x9E3779B97F4A7C15)
    return s ^ (s >> np.uint64(32))


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """How many words a text has (long), counted without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


@atexit.register
def _sweep() -> None:
    for spark, path in list(_scratch):
        try:
            discard(spark, path)
        except Exception:  # the JVM has gone first; the folder belongs to the cluster
            return
