"""Choosing and dropping frames. Order is a column, never the order of partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def every_nth(df: DataFrame, n: int, order: str = "frame_idx") -> DataFrame:
    if n < 1:
        raise ValueError("the interval must be 1 or more")
    return df.filter(F.col(order) % n == 0)


def frame_at(df: DataFrame, index: int, by: Sequence[str] = (), order: str = "frame_idx") -> DataFrame:
    """One frame of each group: by its index, or counted from the end if negative."""
    if index >= 0:
        return df.filter(F.col(order) == index)
    if index == -1:  # the last frame is a maximum, which combines before the shuffle
        last = df.groupBy(*by).agg(F.max(order).alias(order))
        return df.join(last, [*by, order], "left_semi")
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return df.withColumn("_r", rank).filter(F.col("_r") == -index).drop("_r")


def window_slice(df: DataFrame, start: int = 0, stride: int = 1, limit: int | None = None, order: str = "frame_idx") -> DataFrame:
    """Frames start, start + stride, ..., at most ``limit`` of them."""
    if stride < 1:
        raise ValueError("the stride must be 1 or more")
    end = None if limit is None else start + stride * limit
    ok = (F.col(order) >= start) & ((F.col(order) - start) % stride == 0)
    return df.filter(ok if end is None else ok & (F.col(order) < end))


def sliced(df: DataFrame, index: str, by: Sequence[str] = (), order: str = "frame_idx") -> DataFrame:
    """The frames that a Python index ("-1") or slice ("2:", "::5", "-10::2") takes of
    each group; the step must be positive."""
    parts = [p.strip() for p in index.split(":")]
    if len(parts) == 1:
        return frame_at(df, int(parts[0]), by, order)
    if len(parts) > 3:
        raise ValueError(f"{index} is no slice")
    start, stop, step = (int(p) if p else None for p in (*parts, "", "")[:3])
    if step is not None and step < 1:
        raise ValueError("the step must be 1 or more")
    at, first = F.col(order), F.lit(start or 0)
    if (start or 0) < 0 or (stop or 0) < 0:
        df = df.join(df.groupBy(*by).agg((F.max(order) + 1).alias("_n")), list(by)) if by else df.crossJoin(F.broadcast(df.agg((F.max(order) + 1).alias("_n"))))
        first = F.greatest(F.lit(0), F.col("_n") + start) if (start or 0) < 0 else first
    ok = (at >= first) & ((at - first) % (step or 1) == 0)
    if stop is not None:
        ok = ok & (at < (F.col("_n") + stop if stop < 0 else F.lit(stop)))
    return df.filter(ok).drop("_n")


def choose(df: DataFrame, mode: str, value: int = 1, order: str = "frame_idx") -> DataFrame:
    """``mode`` all, single (frame ``value``) or every (every ``value``-th)."""
    if mode == "all":
        return df
    if mode == "single":
        return frame_at(df, value, order=order)
    if mode == "every":
        return every_nth(df, value, order)
    raise ValueError("mode must be all, single or every")


def successful(df: DataFrame) -> DataFrame:
    """Frames without an error whose grid and spectrum are there."""
    return df.filter(F.col("error").isNull() & F.col("k").isNotNull() & F.col("chi").isNotNull())


def without_leading_zero(df: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Drops the first point of a spectrum where its k is 0."""
    return df.filter(~((F.col("k_idx") == 0) & (F.abs("k") < tolerance)))


def unequal_counts(df: DataFrame, by: Sequence[str], frame: str = "frame_idx") -> DataFrame:
    """Groups whose frames do not all hold the same number of atoms."""
    per = df.groupBy(*by, frame).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.min("n").alias("fewest"), F.max("n").alias("most")).filter("fewest != most")


def equal_id_sets(df: DataFrame, by: Sequence[str], frame: str = "frame_idx", key: str = "atom_id") -> DataFrame:
    """(by, same): whether each group's first and last frame hold the same ids, as often."""
    ends = df.groupBy(*by).agg(F.min(frame).alias("_first"), F.max(frame).alias("_last"))
    ids = lambda end: F.array_sort(F.collect_list(F.when(F.col(frame) == F.col(end), F.col(key))))
    both = df.join(ends, list(by)).filter((F.col(frame) == F.col("_first")) | (F.col(frame) == F.col("_last")))
    return both.groupBy(*by).agg((ids("_first") == ids("_last")).alias("same"))


def first_frames(df: DataFrame, n: int = 100, by: Sequence[str] = (), order: str = "frame_idx") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r") if by else df.orderBy(order).limit(n)


def random_share(df: DataFrame, ratio: float, key: str, by: Sequence[str], seed: str = "0") -> DataFrame:
    """Marks round(ratio * N) rows of each group as ``chosen``, in the order of a
    seeded hash, so the choice is the same in every run."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed))), key))
    return df.withColumn("chosen", rank <= F.bround(F.lit(ratio) * F.count("*").over(w), 0))
