"""Sharding by histogram sort.

Rows are ordered by a 64-bit hash of their text, then by doc_id, so equal texts lie
together. Splitters that cut this order into ranges of equal bytes are found by rounds:
every partition counts the exact bytes below evenly spaced probes in the intervals that
still hold a splitter, and the interval that holds it shrinks to two neighbouring
probes, until a probe is within tolerance. A hash value that alone outweighs the
tolerance (a large group of equal texts) is cut further by doc_id in the same way. Inside
a shard, equally wide cells of the hash are the ranges that tasks sort; a text that
outweighs a cell gets ranges of doc_id of its own. Then each row moves once, to its range.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, table

Key = tuple[int, int]
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _below(column: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most the value."""
    if not bounds:
        return F.lit(0)
    xs = F.array(*(F.lit(b).cast("long") for b in bounds))
    return F.size(F.filter(xs, lambda b: b <= column))


def _refine(rows: DataFrame, key: str, wanted: list[tuple[int, int, int, int, int]], probes: int, tolerance: int, whole: int) -> dict[int, tuple[int, bool]]:
    """For each wanted (splitter, target, low, bytes below low, high): the boundary b whose
    bytes below come within ``tolerance`` of the target, or nearest to it where one row
    decides; with True where rows of one key straddle the target and cutting them apart
    is worth it, as neither edge of theirs is within ``whole``."""
    state = {s: (low, high, base, target) for s, target, low, base, high in wanted}
    found: dict[int, tuple[int, bool]] = {}
    while state:
        spans = sorted({(low, high) for low, high, _, _ in state.values()})
        step = {a: max(1, -(-(b - a) // probes)) for a, b in spans}
        long = lambda v: F.lit(v).cast("long")
        array = F.array(*(F.struct(long(a).alias("low"), long(b).alias("high"), long(step[a]).alias("width")) for a, b in spans))
        at = _below(F.col(key), [a for a, _ in spans])
        span = F.when(at > 0, F.element_at(array, F.greatest(at, F.lit(1))))
        wide = "DECIMAL(20,0)"
        cell = F.expr(f"CAST((CAST({key} AS {wide}) - CAST(s.low AS {wide})) div CAST(s.width AS {wide}) AS INT)")
        inside = rows.select(key, "size", span.alias("s")).filter(F.col(key) < F.col("s.high")).select(F.col("s.low").alias("low"), cell.alias("cell"), "size")
        got = inside.groupBy("low", "cell").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()  # at most probes + 1 an interval
        counts = {(r["low"], r["cell"]): (r["w"], r["n"]) for r in got}
        for s, (a, b, base, target) in list(state.items()):
            below, c, width = base, 0, step[a]
            while below + counts.get((a, c), (0, 0))[0] <= target and a + (c + 1) * width < b:
                below, c = below + counts.get((a, c), (0, 0))[0], c + 1
            w, n = counts.get((a, c), (0, 0))
            start, end = a + c * width, min(b, a + (c + 1) * width)
            left, right = target - below, below + w - target
            if left <= tolerance or n <= 1 and left <= right:
                found[s] = (start, False)
            elif right <= tolerance or n <= 1:
                found[s] = (end, False)
            elif width == 1:
                found[s] = (start if left <= right else end, False) if min(left, right) <= whole else (start, True)
            else:
                state[s] = (start, end, below, target)
                continue
            del state[s]
    return found


def splitters(keys: DataFrame, n: int, *, probes: int = 256, tolerance: float = 0.002, whole: float = 0.02) -> list[Key]:
    """``n - 1`` ascending (hash, doc_id) keys, each the first of its range, that cut
    ``keys`` (hash, doc_id, size) into ranges of near equal bytes. Bytes counted are
    exact; a splitter stops within ``tolerance`` of a range's bytes or beside one row, and
    cuts a group of equal texts only where it would be off by ``whole`` of them otherwise."""
    total = keys.agg(F.sum("size")).collect()[0][0] or 0
    slack = int(total / n * tolerance)
    targets = {s: total * s // n for s in range(1, n)}
    first = _refine(keys, "hash", [(s, t, LOW, 0, HIGH) for s, t in targets.items()], probes, slack, int(total / n * whole))
    out: dict[int, Key] = {s: (h, LOW) for s, (h, tied) in first.items() if not tied}
    heavy: dict[int, list[int]] = {}
    for s, (h, tied) in first.items():
        if tied:
            heavy.setdefault(h, []).append(s)
    for h, group in heavy.items():  # large groups of equal texts, at most one a splitter
        same = keys.filter(F.col("hash") == h)
        below = keys.filter(F.col("hash") < h).agg(F.sum("size")).collect()[0][0] or 0
        for s, (d, _) in _refine(same, "doc_id", [(s, targets[s], LOW, below, HIGH) for s in group], probes, slack, int(total / n * whole)).items():
            out[s] = (h, d)
    return [out[s] for s in sorted(out)]


RANGE = ["shard", "cell", "heavy", "piece"]
BROADCAST_ROWS = 1_000_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shard_of(cuts: list[Key], key: Column, order_id: Column) -> Column:
    """How many of the cuts are at or below the row."""
    hashes = [h for h, _ in cuts]
    where = _below(key, hashes)
    for h in sorted({h for h, d in cuts if d != LOW}):  # rows of a hash that is cut by doc_id
        where = F.when(key == h, bisect_right(hashes, h - 1) + _below(order_id, [d for x, d in cuts if x == h])).otherwise(where)
    return where.cast("int")


def _cell_of(cuts: list[Key], per: int) -> Column:
    """The cell of a row inside its shard: one of ``per`` equally wide stretches of the
    shard's hashes. It never falls as the hash grows."""
    if per == 1:
        return F.lit(0)
    edges = [float(LOW), *(float(h) for h, _ in cuts), float(HIGH)]
    width = [max(1.0, (b - a) / per) for a, b in zip(edges, edges[1:])]
    at = F.col("shard") + 1
    lows, widths = F.array(*map(F.lit, edges[:-1])), F.array(*map(F.lit, width))
    cell = F.floor((F.col("hash").cast("double") - F.element_at(lows, at)) / F.element_at(widths, at))
    return F.greatest(F.lit(0), F.least(F.lit(per - 1), cell)).cast("int")


def _with_ranges(rows: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Adds ``heavy`` and ``piece``: of a row of a heavy text the hash and the stretch of
    doc_id, of others null and 0."""
    if heavy is None:
        return rows.withColumns({"heavy": F.lit(None).cast("long"), "piece": F.lit(0)})
    piece = F.greatest(F.lit(0), F.floor((F.col("order_id").cast("double") - F.col("low")) / F.col("width"))).cast("int")
    mark = heavy.select("shard", F.col("hash").alias("heavy"), "low", "width")
    on = (rows["shard"] == mark["shard"]) & (rows["hash"] == mark["heavy"])
    return rows.join(_few(mark), on, "left").drop(mark["shard"]).withColumn("piece", F.coalesce(piece, F.lit(0))).drop("low", "width")


def shard(df: DataFrame, n_shards: int = 40, *, range_bytes: int = 256 << 20) -> DataFrame:
    """Adds size (UTF-8 bytes of ``text`` plus 16; null: none plus 16), text_crc32,
    shard (0 .. ``n_shards`` - 1) and slot (gapless from 0 in each shard) to every row of
    ``df``; all its other columns move along.

    Shards hold near equal bytes. A shard of more than ``range_bytes`` is sorted in cells
    of about that size, and the rows of a text that alone has more in stretches of
    doc_id, so no task holds a whole large shard; only ``n_shards`` - 1 splitters ever
    reach a plan or the driver. Slots follow the hash, heavy texts after the rest of
    their cell. Rows that share text and doc_id come in any order; a null doc_id sorts
    first; a very long text is a row like any other; an empty table gives no row; columns
    named like the added ones are replaced, all others come through.
    """
    added = ("size", "text_crc32", "shard", "slot")
    row = [c for c in df.columns if c not in added]
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = df.select(F.struct(*row).alias("row"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("hash"), F.coalesce(F.col("doc_id"), F.lit(LOW)).cast("long").alias("order_id"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    full = slim.withColumn("size", F.col("bytes") + 16).drop("bytes")
    keys, path = table(full.select("hash", F.col("order_id").alias("doc_id"), "size"), "shard-keys")
    total = keys.agg(F.sum("size")).collect()[0][0] or 0
    per = max(1, -(-total // (n_shards * range_bytes)))
    cuts = splitters(keys, n_shards)
    placed = full.withColumn("shard", _shard_of(cuts, F.col("hash"), F.col("order_id")))
    placed = placed.withColumn("cell", _cell_of(cuts, per))
    heavy = None
    if per > 1:
        at = keys.withColumnRenamed("doc_id", "order_id").withColumn("shard", _shard_of(cuts, F.col("hash"), F.col("order_id"))).withColumn("cell", _cell_of(cuts, per))
        over, over_path = table(at.groupBy("shard", "cell").agg(F.sum("size").alias("w")).filter(F.col("w") > 2 * range_bytes).select("shard", "cell"), "heavy-cells")
        same = at.join(_few(over), ["shard", "cell"]).groupBy("shard", "hash").agg(F.sum("size").alias("w"), F.coalesce(F.min(F.when(F.col("order_id") != LOW, F.col("order_id"))), F.lit(0)).cast("double").alias("low"), F.max("order_id").cast("double").alias("high"))
        heavy, _ = table(same.filter(F.col("w") > range_bytes).select("shard", "hash", "low", F.greatest(F.lit(1.0), (F.col("high") - F.col("low") + 1) / F.ceil(F.col("w") / range_bytes)).alias("width")), "heavy-texts")
        discard(df.sparkSession, over_path)
        counts, _ = table(_with_ranges(at, heavy).groupBy(*RANGE).agg(F.count("*").alias("n")), "range-counts")
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell", F.asc_nulls_first("heavy"), "piece").rowsBetween(Window.unboundedPreceding, -1))
        counts, _ = table(counts.select(*(F.col(c).alias(f"r_{c}") for c in RANGE), F.coalesce(before, F.lit(0)).alias("before")), "range-starts")
    discard(df.sparkSession, path)
    placed = _with_ranges(placed, heavy)
    slot = F.row_number().over(Window.partitionBy(*RANGE).orderBy("hash", "order_id")) - 1
    placed = placed.withColumn("slot", slot.cast("long"))
    if per > 1:
        on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in RANGE]
        placed = placed.join(_few(counts), on).withColumn("slot", F.col("slot") + F.col("before"))
    return placed.select("row.*", "size", "text_crc32", "shard", "slot")
