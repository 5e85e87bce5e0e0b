"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of copies the mix wants of it. Among all rates
between 0 and ``cap`` that meet each source's token target, the ones closest in entropy
to "each document once" are the exponential tilts
    rate = cap * odds / (1 + odds),  odds = exp(tilt[source] * size / scale) / (cap - 1)
and the tilts maximise a concave dual, one dimension a source. Newton steps solve it, each a
grouped aggregation over the counts of (source, size). Rates become copies by a hashed
draw per document; a bounded set of documents in each source is rounded last, largest
first, against what the source still lacks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, n_words, table

#: Documents of each power-of-two size class of a source that are rounded last.
LAST = 64


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, sid, source_size, target): shares of all sizes by weight, at most ``cap``
    times a source's size, the excess shared again by weight until none is above."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("sid", F.row_number().over(order))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    every = Window.partitionBy(F.lit(1))
    # Sources fill up in the order of most / weight; the level is set by those that do not.
    up = every.orderBy(F.col("most") / F.col("weight"), "sid")
    before = lambda c: F.coalesce(F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("level", (F.sum("source_size").over(every) - before("most")) / (F.sum("weight").over(every) - before("weight")))
    open_ = F.col("level") * F.col("weight") <= F.col("most")
    per = per.withColumn("final", F.max(F.when(open_, F.col("level"))).over(every))
    return per.select("source", "sid", "source_size", F.least("most", F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def _rate(cap: float):
    z = F.col("tilt") * F.col("size") / F.col("scale") - math.log(cap - 1)
    return F.lit(float(cap)) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))


def tilts(hist: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-7, most_steps: int = 40) -> DataFrame:
    """(sid, tilt, scale) for each source, from (sid, size, n) counts: Newton steps on
    the dual, kept inside a bracket that each gradient's sign narrows."""
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    scale = hist.groupBy("sid").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"))
    state = goals.join(scale, "sid").select("sid", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), F.when(full, 1e9).otherwise(0.0).alias("tilt"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), full.alias("done"))
    state, path = table(state, "tilts")
    for _ in range(most_steps):
        if not state.filter("NOT done").limit(1).count():
            break
        r = _rate(cap)
        at = hist.join(state.filter("NOT done").select("sid", "tilt", "scale"), "sid")
        at = at.select("sid", (F.col("n") * F.col("size") * r).alias("f"), (F.col("n") * F.col("size") * F.col("size") / F.col("scale") * r * (1 - r / cap)).alias("d"))
        grad = at.groupBy("sid").agg(F.sum("f").alias("f"), F.sum("d").alias("d"))
        miss = F.col("target") - F.col("f")
        near = F.abs(miss) <= tolerance * F.greatest("target", F.lit(1.0))
        low, high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("low")), F.when(miss < 0, F.col("tilt")).otherwise(F.col("high"))
        reach = 4 + 2 * F.abs("tilt")
        step = F.greatest(-reach, F.least(reach, miss / F.greatest("d", F.lit(1e-300))))
        nxt = F.when((F.col("tilt") + step > low) & (F.col("tilt") + step < high), F.col("tilt") + step).otherwise((low + high) / 2)
        moved = state.join(grad, "sid", "left").select(
            "sid", "target", "scale",
            F.when(F.col("done") | near, F.col("tilt")).otherwise(nxt).alias("tilt"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | F.coalesce(near, F.lit(True))).alias("done"),
        )
        old = path
        state, path = table(moved, "tilts")
        discard(hist.sparkSession, old)
    return state.select("sid", "tilt", "scale")


def mix(df: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3) -> DataFrame:
    """Adds size, source_size, target, rate and copies (0 to ``cap``) to every row of
    ``df`` (doc_id, text, source, and any others, which are carried along under their
    names; columns named like the added ones are replaced).

    Sources are ordered by code point, null last, and weigh ``weights``, repeating. The
    draw depends on doc_id and size only, so reruns agree and rows that repeat a doc_id
    and size share one number of copies. A null or empty text has size 0; a very long
    one is counted whole, and where it is most of its source the target is missed by half
    of it at most; an empty table gives no row.
    """
    added = ("size", "source_size", "target", "rate", "copies")
    carried = [c for c in df.columns if c not in added]
    size = n_words(F.col("text"))
    slim, slim_path = table(df.select("doc_id", "source", size.alias("size")), "sizes")
    goals, _ = table(targets(slim, weights, cap), "targets")
    ided = slim.join(goals.select("source", "sid").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = ided.select("sid", "size", F.xxhash64("doc_id", "size").alias("key"), F.floor(F.log2(F.col("size") + 1)).cast("int").alias("class"))
    keyed, keys_path = table(keyed, "keys")
    hist, _ = table(keyed.groupBy("sid", "size").agg(F.count("*").alias("n")), "histogram")
    state, _ = table(goals.join(tilts(hist, goals, cap), "sid"), "state")

    # The documents rounded last: in each class, those hashed below the class's edge.
    rank = F.row_number().over(Window.partitionBy("sid", "class").orderBy("key"))
    edges, _ = table(keyed.withColumn("r", rank).filter(F.col("r") <= LAST + 1).groupBy("sid", "class").agg(F.max(F.when(F.col("r") == LAST + 1, F.col("key"))).alias("edge")), "edges")
    chosen = F.coalesce(F.col("key") < F.col("edge"), F.lit(True))
    u = F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit("copies")), 11) / F.lit(float(1 << 53))
    drawn = F.least(F.lit(cap), F.floor(F.col("rate") + u).cast("int"))
    rated = keyed.join(edges, ["sid", "class"]).join(state.select("sid", "target", "tilt", "scale"), "sid").withColumn("rate", _rate(cap)).withColumn("chosen", chosen)
    taken = rated.filter(~F.col("chosen")).groupBy("sid").agg(F.sum(drawn * F.col("size")).alias("taken"))
    last = rated.filter("chosen AND size > 0").groupBy("sid", "key", "size", "rate").agg(F.count("*").alias("m"))
    lists = last.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("minus"), "key", "m", "rate"))).alias("items"))
    lists = lists.join(taken, "sid", "left").join(state.select("sid", "target"), "sid")
    lists = lists.select("sid", "items", (F.col("target") - F.coalesce("taken", F.lit(0))).alias("lack"))
    weight = lambda x: -x["minus"] * x["m"] * x["rate"]
    start = F.struct(F.col("lack").cast("double").alias("lack"), F.aggregate("items", F.lit(0.0), lambda a, x: a + weight(x)).alias("rest"), F.array().cast("array<int>").alias("copies"))

    def settle(a, x):
        want = x["rate"] * F.greatest(F.lit(0.0), a["lack"]) / F.greatest(a["rest"], F.lit(1e-9))
        v = F.shiftrightunsigned(F.xxhash64(x["key"], F.lit("last")), 11) / F.lit(float(1 << 53))
        small = -x["minus"] * x["m"] * 50 < F.greatest(F.lit(0.0), a["rest"])
        n = F.least(F.lit(cap), F.floor(want + F.when(small, v).otherwise(0.5)).cast("int"))
        return F.struct((a["lack"] + x["minus"] * x["m"] * n).alias("lack"), (a["rest"] - weight(x)).alias("rest"), F.array_append(a["copies"], n).alias("copies"))

    settled = lists.select("sid", F.explode(F.arrays_zip(F.transform("items", lambda x: x["key"]).alias("key"), F.aggregate("items", start, settle, lambda a: a["copies"]).alias("settled"))).alias("x"))
    settled, _ = table(settled.select("sid", "x.key", "x.settled"), "settled")
    if settled.count() <= 1_000_000:  # at most LAST a size class and source; 20 bytes each
        settled = F.broadcast(settled)
    discard(df.sparkSession, slim_path, keys_path)
    goal = state.withColumnRenamed("source", "s")
    rows = df.select(F.struct(*carried).alias("row"), "doc_id", "source", size.alias("size"))  # no other names, so none can clash
    wide = rows.join(F.broadcast(goal) if goal.count() <= 100_000 else goal, F.col("source").eqNullSafe(F.col("s")))
    wide = wide.withColumn("key", F.xxhash64("doc_id", "size")).withColumn("rate", _rate(cap)).join(settled, ["sid", "key"], "left")
    wide = wide.withColumn("copies", F.when(F.col("size") == 0, F.least(F.lit(cap), F.floor(F.col("rate") + u).cast("int"))).otherwise(F.coalesce("settled", drawn)))
    return wide.select("row.*", *added)
