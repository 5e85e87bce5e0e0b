"""Splitters against a full sort, and shards of many ranges."""

from bisect import bisect_right
from collections import defaultdict

from helpers import prose

from chiweave.llm.sharding import LOW, shard, splitters


def test_splitters_equal_a_full_sort(spark):
    rows = [((i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) - (1 << 63), i, 20 + i * 7919 % 300) for i in range(3000)]
    rows += [(12345, 5000 + i, 100) for i in range(1500)]  # a text with a quarter of all bytes
    cuts = splitters(spark.createDataFrame(rows, "hash long, doc_id long, size long"), 8, tolerance=0.002, whole=0.02)
    assert cuts == sorted(cuts) and len(cuts) == 7
    size = [0] * 8
    for h, d, n in rows:
        size[bisect_right(cuts, (h, d))] += n
    mean = sum(size) / 8
    largest = max(n for _, _, n in rows)
    # Each splitter is within its tolerance, or beside one row, of where a sort would put it.
    below = 0
    for k, n in enumerate(size[:-1], 1):
        below += n
        assert abs(below - k * mean) <= 0.002 * mean + largest or abs(below - k * mean) <= 0.02 * mean
    assert any(h == 12345 and d != LOW for h, d in cuts)


def test_thousands_of_ranges_keep_slots_gapless(spark):
    rows = [(i, prose(i, 12)) for i in range(4000)] + [(10_000 + 3 * i, "one text that many rows share") for i in range(2000)] + [(None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS cell", "'x' AS heavy", "1 AS hash")
    got = shard(df, 8, range_bytes=40)  # a thousand and more cells a shard, of two rows or so
    assert got.columns == ["doc_id", "text", "cell", "heavy", "hash", "size", "text_crc32", "shard", "slot"]
    by, where = defaultdict(list), {}
    for r in got.collect():
        by[r["shard"]].append(r)
        where[r["doc_id"], r["text"]] = r["shard"]
        assert r["cell"] == r["doc_id"] and r["heavy"] == "x"
    assert len(where) == len(rows) and set(by) == set(range(8))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    size = [sum(r["size"] for r in part) for part in by.values()]
    assert max(size) - min(size) <= 0.03 * sum(size) / 8
    plain = {(r["doc_id"], r["text"]): r["shard"] for r in shard(df, 8).collect()}
    assert plain == where  # the size of a range decides no shard
