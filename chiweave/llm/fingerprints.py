"""Quartile bucket digests of whole texts.

A digest counts hashed byte triplets of the UTF-8 text in 1024 buckets and keeps, for
each bucket, the quartile of its count (two bits), with the length on a log scale and
the spread of the quartiles. Two digests compare by a bounded difference: steps between
quartiles, an opposite pair counting double, plus the difference in length.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
#: Difference of two unrelated digests, from which on nothing is alike: the mean of
#: _STEP over 16 equally likely pairs, for each bucket.
UNLIKE = 1.625 * BUCKETS
_AT = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int16)


def digest(text: str) -> bytes:
    """258 bytes: log length, spread, and 1024 quartile codes. Padded by two zero
    bytes, so even one character leaves a trace; an empty text has codes of 0."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), 1 << 20):  # whole text, a bounded stretch at a time
        x = np.frombuffer((raw[at : at + (1 << 20) + 2] + b"\0\0")[: min(1 << 20, len(raw) - at) + 2], np.uint8).astype(np.uint32)
        h = x[:-2] * np.uint32(2654435761) + x[1:-1] * np.uint32(2246822519) + x[2:] * np.uint32(3266489917)
        counts += np.bincount((h ^ (h >> np.uint32(15))) >> np.uint32(22), minlength=BUCKETS)
    q1, q2, q3 = (int(x) for x in np.partition(counts, _AT)[_AT])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, round(8 * math.log2(1 + len(raw))))
    spread = (15 * q1 // q3) << 4 | 15 * q2 // q3 if q3 else 0
    return bytes((length, spread)) + packed.astype(np.uint8).tobytes()


def _codes(d: bytes) -> np.ndarray:
    p = np.frombuffer(d, np.uint8)[2:]
    return np.stack([p & 3, p >> 2 & 3, p >> 4 & 3, p >> 6], axis=1).ravel()


def difference(a: bytes, b: bytes) -> int:
    """At most 6 for each bucket, 64 for the length (4 a doubling) and 30 for the
    spread; 0 for equal digests."""
    steps = int(_STEP[_codes(a), _codes(b)].sum())
    length = min(64, max(0, abs(a[0] - b[0]) - 1) // 2)
    return steps + length + abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 from the difference of unrelated ones on."""
    return 1.0 if a == b else max(0.0, 1.0 - difference(a, b) / UNLIKE)


def edited(text: str, other: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many, or
    all, of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_order_with_next(df: DataFrame, n: int) -> DataFrame:
    """Rows (part, tail, doc_id, text), dealt by ranges of doc_id and sorted inside: each
    row's successor follows it, and a range ends with a copy (tail 1) of the first row of the
    next range, or of the first of all. Ties are ordered by text, nulls first."""
    low = -(1 << 63)
    order = F.coalesce(F.col("doc_id"), F.lit(low))
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)).collect()[0][0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c < order)) if cuts else F.lit(0)
    full = df.select(part.alias("part"), F.lit(0).alias("tail"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = sorted((r["part"], r["first"]) for r in df.select(part.alias("part"), order.alias("o")).groupBy("part").agg(F.min("o").alias("first")).collect())  # a row a range
    follows = [(first[i][0], first[(i + 1) % len(first)][1]) for i in range(len(first))]
    spark = df.sparkSession
    heads = F.broadcast(spark.createDataFrame(follows, "part int, o long"))  # n rows at most
    tails = df.select(order.alias("o"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(heads.select("o").distinct()), "o", "left_semi")
    tails = tails.groupBy("o", "doc_id").agg(F.min("text").alias("text")).join(heads, "o").select("part", F.lit(1).alias("tail"), "doc_id", "text")
    return full.unionByName(tails).repartition(n, "part").sortWithinPartitions("part", "tail", "doc_id", "text")


def fingerprints(df: DataFrame, keep_texts: bool = False) -> DataFrame:
    """Digests every whole text (null: empty) and its edit with the next document, by
    ascending doc_id, the first following the last. Returns a row per row of ``df``.

    Texts move once, dealt by ranges of doc_id; a task keeps one text besides its batch.
    Equal texts have equal fingerprints. Rows that share a doc_id follow each other by
    text; a single row follows itself; an empty table gives no row; other columns are
    not read. ``keep_texts`` adds the edited text.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (part, doc_id, text, digest)
        for frame in frames:
            rows = []
            ids = [None if pd.isna(i) else int(i) for i in frame["doc_id"]]
            for part, tail, doc_id, text in zip(frame["part"].tolist(), frame["tail"].tolist(), ids, frame["text"].tolist()):
                own = digest(text)
                if held is not None and held[0] == part:
                    _, before, t, d = held
                    e = edited(t, text)
                    x = d if e == t else digest(e)
                    rows.append((before, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), d.hex(), x.hex(), likeness(d, x), likeness(d, own), *([e] if keep_texts else [])))
                held = None if tail else (part, doc_id, text, own)
            out = pd.DataFrame(rows, columns=[c for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *(["edited_text"] if keep_texts else []))])
            yield out.astype({"doc_id": "Int64"})

    return in_order_with_next(df.select("doc_id", "text"), n).mapInPandas(run, OUT + (", edited_text string" if keep_texts else ""))
