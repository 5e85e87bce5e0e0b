"""Best-fit packing of token sequences, planned on counts of lengths.

Documents become pieces of at most ``capacity`` tokens. The dealt method range-sorts
documents and gaps, matches them by distributed successor sweeps, resolves conflicts by
rank, updates the gaps and repeats. Here the sweeps run over runs instead of rows: pieces
of one length are interchangeable, so pieces and gaps are held as one run per length, and
a step moves the longest run left to its successor, the smallest gap that holds it; which
of its pieces get there is decided by rank; the gaps shrink, and the next step begins. So
the steps are a loop on the driver over at most ``capacity`` counts, whatever the number of
documents, and there is no exchange per step: each row finds its own match from its length
and its exact rank among the pieces of that length. The result equals best-fit decreasing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, trim
from .tokens import blocks, shared_encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, local_rank long"


def schedule(counts: dict[int, int], capacity: int) -> np.ndarray:
    """The matches of all supersteps, as rows (length, first rank, end rank, first
    sequence, pieces per sequence, offset), ordered by length and rank.

    Equals best-fit decreasing on the expanded pieces: a class's piece goes to the
    smallest gap that holds it, which, once it has shrunk, is the best fit for the next
    of the class as long as it holds one.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, sequences)
    sizes: list[int] = []  # the gaps that have runs, ascending
    out, opened = [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            gap = sizes[at] if at < len(sizes) else capacity
            full = gap // length
            if at < len(sizes):
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            else:
                first, n = opened, max(1, left // full)
                opened += n
            used, each = (min(n, left // full), full) if left >= full else (1, left)
            for base, m, free in ((first, used, gap - each * length), (first + used, n - used, gap)):
                if m and free:
                    if not gaps[free]:
                        insort(sizes, free)
                    gaps[free].append((base, m))
            out.append((length, rank, rank + used * each, first, each, capacity - gap))
            rank, left = rank + used * each, left - used * each
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 6)


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, local_rank): the documents' ids cut
    into pieces; the first of several is the shorter one."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, encode, end = TaskContext.get().partitionId(), shared_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for frame in frames:
            ids, texts = [None if pd.isna(i) else int(i) for i in frame["doc_id"]], frame["text"].tolist()
            for a, b in blocks(texts):
                rows = []
                for doc_id, x in zip(ids[a:b], encode([t or "" for t in texts[a:b]])):
                    x += end
                    n = len(x) // 4
                    at, piece, step = 0, 0, (n - 1) % capacity + 1
                    while at < n:
                        rows.append((doc_id, piece, at, step, x[4 * at : 4 * (at + step)], part, int(seen[step])))
                        seen[step] += 1
                        at, piece, step = at + step, piece + 1, capacity
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids", "part", "local_rank"])
                yield out.astype({"doc_id": "Int64"})
        trim()

    return df.select("doc_id", "text").mapInPandas(cut, PIECES)


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Packs ``text`` of every row (null: empty) into sequences of at most ``capacity``
    ids. Returns a row per piece: doc_id, piece, start, length, ids (binary, little-endian
    unsigned 32-bit; left out unless ``keep_ids``), ids_crc32, sequence_id and offset;
    sequences have no gaps inside.

    Repeated rows are packed as often as they come; ties are broken by rank; a null
    doc_id is kept; a very long text is cut into as many pieces as it needs; columns other
    than doc_id and text are not read; an empty table gives no row. What reaches the driver is a count per
    length, at most ``capacity`` of them; a class that holds most rows is ranked from
    counts per partition, never gathered.
    """
    spark = df.sparkSession
    kept, _ = table(pieces(df, tokenizer, capacity, end_id), "pieces")
    counts, _ = table(kept.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(schedule(totals, capacity))
    w = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("part", "length", F.coalesce(w, F.lit(0)).alias("before"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = plan.value
        key = p[:, 0] * (1 << 45) + p[:, 1]
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            i = np.searchsorted(key, length * (1 << 45) + rank, side="right") - 1
            r = rank - p[i, 1]
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            frame["sequence_id"], frame["offset"] = p[i, 3] + r // p[i, 4], p[i, 5] + length * (r % p[i, 4])
            yield frame.drop(columns="rank")

    cols = ["doc_id", "piece", "start", "length", *(["ids"] if keep_ids else []), "ids_crc32"]
    ranked = kept.withColumn("ids_crc32", F.crc32("ids")).select(*cols, "part", "local_rank").join(before.hint("merge"), ["part", "length"])
    ranked = ranked.select(*cols, (F.col("before") + F.col("local_rank")).alias("rank"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(*cols).schema)
    return ranked.mapInPandas(place, f"{types}, sequence_id long, offset long")
