"""N-gram Jaccard self-join by a MinHash LSH forest.

Equal texts are one class. A class's signature is cut into trees of ``DEPTH`` labels;
classes that share a prefix of a tree's labels stand together in its trie. Prefixes are
shortened label by label until a link at the threshold itself is found with the target
recall; the chance is known beforehand, so one length serves all, and no group of many
alike texts decides what other groups lose. The nodes of that length are brought together
by a hash of their prefix, 16 bytes a class and tree: sorting whole signatures would put
the same classes side by side, but move all labels of all trees. Candidates are then
verified on exact shingle sets, group by group; connected classes form a larger group.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, only_cache, run_hashes, skewed_join, table, trim

TREES, DEPTH = 16, 12
#: A trie node with more classes is compared block by block, each pair of blocks a task's work.
BLOCK = 256
#: Below this many rows (of 16 to 40 bytes) a side is broadcast; above, it is shuffled.
BROADCAST_ROWS = 1_000_000
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def shingles(text: str | None, n: int, words: WordHashes) -> np.ndarray:
    """Hashes of all runs of ``n`` words, with repeats; of the whole text if it has
    fewer; none if it has no word. Words are split at ASCII white space only."""
    raw = (text or "").encode("utf-8", "surrogatepass").split()
    return run_hashes(words.of(raw, len(raw)), min(n, len(raw))) if raw else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> bytes:
    """16 bits of each of the smallest values under ``TREES * DEPTH`` hashes."""
    x = (s >> np.uint64(16)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        v = x[at : at + 2048, None] * _A
        v += _B
        np.minimum(low, v.min(0), out=low)
    return ((low * np.uint32(2654435761)) >> np.uint32(16)).astype("<u2").tobytes()


_words = WordHashes()


def _signed(df: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, sig) of every row; key is the text's MD5, sig null without words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only_cache("words", _words.clear)
        recent: OrderedDict[bytes, bytes | None] = OrderedDict()  # copies need no second signature
        for frame in frames:
            keys, sigs = [], []
            for text in frame["text"]:
                key = hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()
                if key not in recent:
                    s = shingles(text, n, _words)
                    recent[key] = signature(s) if len(s) else None
                    if len(recent) > 4096:
                        recent.popitem(last=False)
                keys.append(key)
                sigs.append(recent[key])
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "key": keys, "sig": sigs})
        trim()

    return df.select("doc_id", "text").mapInPandas(run, "doc_id long, key binary, sig binary")


MEMBERS = "node long, tree int, key binary, own int, lo int, hi int, alike double, n long"
PLACE = ["node", "tree", "key", "own", "lo", "hi"]


def _nodes(classes: DataFrame, depth: int) -> DataFrame:
    """The forest's nodes of two classes or more at ``depth``, a row per class and block
    pair: (node, tree, key, own, lo, hi). A small node is one block, paired with itself."""
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring(F.col("sig"), t * 2 * DEPTH + 1, F.lit(2 * depth)))))
    nodes = classes.select("key", tree.alias("tree", "node"))
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    rows = nodes.join(sizes, "node").withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("key", "node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.select("node", "tree", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _groups(rows: DataFrame, payload: str, work, schema: str) -> DataFrame:
    """Runs ``work`` over the members of each node's pair of blocks, standing together
    after one sort; ``work.end`` may add rows when a partition is through."""
    columns = [*PLACE, payload] if payload == "sig" else [*PLACE, "sig", payload]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        held: list[tuple] = []
        state: dict = {}
        for frame in frames:
            out: list[tuple] = []
            for row in zip(*(frame[c] for c in columns)):
                if held and (row[0], row[4], row[5]) != (held[0][0], held[0][4], held[0][5]):
                    out += work(held, state)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(work(held, state), columns=names)
        if state:
            yield pd.DataFrame([(None,) * 6 + x for x in state.items()], columns=names).astype({"node": "Int64", "tree": "Int64", "own": "Int64", "lo": "Int64", "hi": "Int64"})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*columns).repartition(n, "node", "lo", "hi").sortWithinPartitions("node", "lo", "hi").mapInPandas(walk, schema)


def _first_met(group: list[tuple], depth: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """For every two members, whether this node is the first to pair them with
    signatures that agree in ``floor`` or more, above the diagonal; and their agreement."""
    tree, lo, hi = int(group[0][1]), group[0][4], group[0][5]
    s = np.frombuffer(b"".join(bytes(g[6]) for g in group), "<u2").reshape(len(group), TREES, DEPTH)
    own, keys = np.array([g[3] for g in group]), [bytes(g[2]) for g in group]
    ok, alike = np.zeros((len(group), len(group)), bool), np.zeros((len(group), len(group)))
    for i in range(len(group) - 1):
        eq = s[i + 1 :] == s[i]
        alike[i, i + 1 :] = eq.mean((1, 2))
        shared = eq[:, :, :depth].all(2)
        ok[i, i + 1 :] = (alike[i, i + 1 :] >= floor) & shared[:, tree] & ~shared[:, :tree].any(1)
    if lo != hi:
        ok &= own[:, None] != own[None]
    if len(set(keys)) < len(keys):
        ok &= np.array([[a != b for b in keys] for a in keys])
    return ok, alike


def _candidates(classes: DataFrame, depth: int, floor: float) -> DataFrame:
    """Members of nodes where they meet a candidate for the first time (``MEMBERS``, alike
    null), and how many pairs agree how much (key null): never a row per pair."""

    def work(group: list[tuple], state: dict) -> list[tuple]:
        ok, alike = _first_met(group, depth, floor)
        for x, n in zip(*np.unique(alike[ok], return_counts=True)):
            state[float(x)] = state.get(float(x), 0) + int(n)
        return [(*g[:6], None, None) for g, some in zip(group, ok.any(0) | ok.any(1)) if some]

    return _groups(_nodes(classes, depth).join(classes.select("key", "sig"), "key"), "sig", work, MEMBERS)


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements every two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    step = 8192
    for at in range(0, int(column[-1]) + 1, step):
        a, z = np.searchsorted(column, (at, at + step))
        part = np.zeros((len(sets), step), np.float32)
        part[owner[a:z], column[a:z] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verified(members: DataFrame, exact: DataFrame, depth: int, floor: float, threshold: float, pairs: bool) -> DataFrame:
    """Exact similarities inside each group: (key, root, n_links) of members with links,
    the root standing for those linked in this group; or the pairs (a, b, similarity)."""

    def links(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        ok, _ = _first_met(group, depth, floor)
        sets = [np.asarray(g[7], np.int64) for g in group]
        size = np.array([len(x) for x in sets])
        both = _shared_counts(sets)
        similar = both / (size[:, None] + size[None] - both)
        return ok & (similar >= threshold), similar

    def stars(group: list[tuple], state: dict) -> list[tuple]:
        ok, _ = links(group)
        ok = ok | ok.T
        root = np.arange(len(group))
        while True:  # the smallest number spreads along links
            low = np.minimum(root, np.where(ok, root[None], len(group)).min(1))
            if (low == root).all():
                break
            root = low
        return [(bytes(g[2]), bytes(group[r][2]), int(n)) for g, r, n in zip(group, root, ok.sum(1)) if n]

    def listed(group: list[tuple], state: dict) -> list[tuple]:
        ok, similar = links(group)
        return [(*sorted((bytes(group[i][2]), bytes(group[j][2]))), float(similar[i, j])) for i, j in zip(*np.nonzero(ok))]

    rows = members.join(exact, "key")
    return _groups(rows, "s", listed, "a binary, b binary, similarity double") if pairs else _groups(rows, "s", stars, "key binary, root binary, n_links long")


def found_share(s: np.ndarray | float, depth: int) -> np.ndarray | float:
    """The chance that two classes of similarity ``s`` share ``depth`` labels in a tree."""
    return 1 - (1 - s**depth) ** TREES


def _depth(threshold: float, recall: float) -> int:
    """The longest prefix that finds links at the threshold itself with a chance of
    ``recall`` or more. Links above it are found more often still, so every link has
    that chance, whatever other links the corpus holds."""
    return next((d for d in range(DEPTH, 1, -1) if found_share(threshold, d) >= recall), 1)


@dataclass
class NearDuplicates:
    """``documents``: doc_id, key, class_id, n_copies, n_links, group_id, a row per row
    of the input. ``links``: a, b (class ids, a < b), similarity, a row per link, if they
    were asked for. ``depth``: the prefix length of the forest."""

    documents: DataFrame
    links: DataFrame | None
    depth: int


def _components(edges: DataFrame) -> DataFrame:
    """(key, root): each node's smallest connected node, by alternating large and small
    stars until the edges stay as they are."""
    spark = edges.sparkSession
    edges, path = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        new, new_path = table(small, "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        discard(spark, path)
        edges, path = new, new_path
        if state == last:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        last = state


def ngram_join(df: DataFrame, *, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, links: bool = False, margin: float | None = 4.0) -> NearDuplicates:
    """Links every two different texts of ``df`` (doc_id, text) whose sets of ``n``-word
    runs have a Jaccard similarity of ``threshold`` or more.

    class_id is the smallest doc_id with the very same text, n_copies the rows that have
    it, n_links the number of other texts linked to it, group_id the smallest doc_id of
    its connected group. A null text equals an empty one; texts without words link to
    nothing; texts with fewer than ``n`` words are one run; repeated rows are copies; a
    null doc_id sorts first; an empty table gives no row; other columns are not read.
    A very long text is signed whole, a stretch of hashes at a time. Links are counted and
    chained where their texts meet; only ``links`` lists them.

    ``recall`` is the chance that a link of exactly ``threshold`` becomes a candidate.
    Candidates whose signatures agree ``margin`` standard deviations below the threshold
    are taken for unlinked (at 4, one link in 30,000 at the threshold itself); None
    verifies every candidate exactly.
    """
    spark = df.sparkSession
    signed, _ = table(_signed(df, n), "signatures")
    low = F.lit(-(1 << 63))
    rows = signed.withColumn("id", F.coalesce("doc_id", low))
    classes, _ = table(rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"), F.first("sig").alias("sig")), "classes")
    signing = classes.filter("sig IS NOT NULL").select("key", "sig")
    floor = 0.0 if margin is None else threshold - margin * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5
    depth = _depth(threshold, recall)
    found, found_path = table(_candidates(signing, depth, floor), "candidates")
    members = found.filter("key IS NOT NULL").select(*PLACE)

    # Exact verification: the shingle sets of candidates only, each from one row.
    wanted, wanted_path = table(members.select("key").distinct().join(classes.select("key", "rep"), "key"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    keyed = df.select("text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), F.coalesce("doc_id", low).alias("rep"))

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only_cache("words", _words.clear)
        for frame in frames:
            s = [np.unique(shingles(t, n, _words)) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "sig": [signature(x) for x in s], "s": [x.view(np.int64) for x in s]})
        trim()

    chosen = keyed.join(F.broadcast(wanted) if few else wanted, ["key", "rep"], "left_semi")
    exact, exact_path = table(chosen.select("key", "text").mapInPandas(sets, "key binary, sig binary, s array<long>").dropDuplicates(["key"]), "shingles")
    linked, linked_path = table(_verified(members, exact, depth, floor, threshold, False), "linked")

    edges = linked.filter("key != root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    grouped, grouped_path = table(_components(edges).join(classes.select("key", "rep", "n_copies"), "key", "right").select("key", "rep", "n_copies", F.coalesce("root", "key").alias("root")), "groups")
    group = grouped.groupBy("root").agg(F.min("rep").alias("group_id"), F.count("*").alias("weight"))
    degree = linked.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    facts = skewed_join(grouped, group, "root", grouped.count()).join(degree, "key", "left")
    facts, _ = table(facts.select("key", F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group_id"), "facts")
    discard(spark, wanted_path, linked_path, grouped_path, *(() if links else (found_path, exact_path)))
    documents = skewed_join(rows.select("doc_id", "key"), facts.withColumn("weight", F.col("n_copies")), "key", signed.count())
    documents = documents.select("doc_id", "key", "class_id", "n_copies", "n_links", "group_id")
    if not links:
        return NearDuplicates(documents, None, depth)
    ids = classes.select("key", "rep")
    named = _verified(members, exact, depth, floor, threshold, True).join(ids.select(F.col("key").alias("a"), F.col("rep").alias("x")), "a").join(ids.select(F.col("key").alias("b"), F.col("rep").alias("y")), "b")
    return NearDuplicates(documents, named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"), depth)


def one_of_each(df: DataFrame, **how: float) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group, the row with the
    smallest doc_id (null first) stays, and one row where it is repeated."""
    found = ngram_join(df.select("doc_id", "text"), **how).documents
    low = F.lit(-(1 << 63))
    ids, ids_path = table(found.select("key", "group_id", F.coalesce("doc_id", low).alias("id")), "ids")
    # Of rows that share the smallest doc_id in a group, the smallest key stays.
    stay = ids.groupBy("group_id").agg(F.min(F.when(F.col("id") == F.col("group_id"), F.col("key"))).alias("stays"), F.count("*").alias("weight"))
    gone, _ = table(skewed_join(ids, stay, "group_id", ids.count()).filter("id != group_id OR key != stays").select("id", "key").distinct(), "removed")
    twice, _ = table(ids.filter("id = group_id").groupBy("id", "key").agg(F.count("*").alias("n")).filter("n > 1").select("id", "key"), "repeated")
    discard(df.sparkSession, ids_path)
    few = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    full = df.withColumn("__id", F.coalesce("doc_id", low)).withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    on = lambda x: (F.col("__id") == x["id"]) & (F.col("__key") == x["key"])
    kept = full.join(few(gone), on(gone), "left_anti")
    if twice.limit(1).count():
        again = kept.join(few(twice), on(twice), "left_semi").dropDuplicates(["__id", "__key"])
        kept = kept.join(few(twice), on(twice), "left_anti").unionByName(again)
    return kept.drop("__id", "__key")
