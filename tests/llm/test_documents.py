import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, awkward, labels, prose

from chiweave.llm import fingerprints as FP
from chiweave.llm import toxicity as module
from chiweave.llm.mixing import mix
from chiweave.llm.near_duplicates import found_share, ngram_join, one_of_each
from chiweave.llm.quality import keep_good, quality_rules
from chiweave.llm.sharding import shard
from chiweave.llm.toxicity import TextCNN, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark)


def sets(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """class, copies, links and group of each text by comparing all pairs."""
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(-1 if d is None else d)
    texts = list(by)
    s = [sets(t) for t in texts]
    links = {(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
    root = list(range(len(s)))
    for _ in s:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    group = defaultdict(list)
    for i, t in enumerate(texts):
        group[root[i]] += by[t]
    degree = Counter(x for p in links for x in p)
    return {t: (min(by[t]), len(by[t]), degree[i], min(group[root[i]])) for i, t in enumerate(texts)}


def chain(n=40):
    """Near copies that each differ by a word from the one before."""
    rows, w = [], prose(900, 120).split()
    for i in range(n):
        w = w[:]
        w[(i * 11) % 120] = f"new{i}"
        rows.append((1000 + i, " ".join(w), "en", "s", 1))
    return rows


def test_join_equals_all_pairs(spark, docs):
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(chain(), DOCS))
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    want = brute(rows)
    text = {(-1 if d is None else d): t or "" for d, t in rows}
    found = ngram_join(both, links=True)
    low = -(1 << 63)
    fix = lambda v: -1 if v == low else v
    got = [(-1 if r["doc_id"] is None else r["doc_id"], fix(r["class_id"]), r["n_copies"], r["n_links"], fix(r["group_id"])) for r in found.documents.collect()]
    assert len(got) == len(rows)
    for d, *facts in got:
        assert tuple(facts) == want[text[d]], d
    assert found.links.count() == sum(w[2] for w in want.values()) // 2
    assert found.links.filter("similarity < 0.8 OR a >= b").count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    from chiweave.llm import near_duplicates as ND

    monkeypatch.setattr(ND, "BLOCK", 8)
    rows = chain()
    want = brute([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"], r["group_id"]) for r in ngram_join(spark.createDataFrame(rows, DOCS)).documents.collect()}
    assert got == {d: want[t] for d, t, *_ in rows}


def test_one_of_each_group_stays(spark, docs):
    got = one_of_each(docs).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == sorted({w[3] for w in want.values()})
    assert set(got[0].asDict()) == set(docs.columns)
    assert one_of_each(docs.limit(0)).count() == 0


def test_shorter_prefixes_find_more():
    assert found_share(0.8, 12) < found_share(0.8, 6) < found_share(0.8, 4)
    assert abs(found_share(0.8, 4) - (1 - (1 - 0.8**4) ** 16)) < 1e-12


def test_fingerprints_follow_each_document_by_the_next(spark, docs):
    got = {r["doc_id"]: r for r in FP.fingerprints(docs, keep_texts=True).collect() if r["doc_id"] != 28}
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for (d, t), (_, other) in zip(order, order[1:] + order[:1]):
        if d == 28:
            continue
        half = len(t) // 2
        e = t[: len(t) - half] + other[:half]
        r = got[d]
        assert r["edited_text"] == e and r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == FP.digest(t).hex() and r["near_next"] == FP.likeness(FP.digest(t), FP.digest(other))
    assert FP.fingerprints(docs.limit(0)).count() == 0
    one = FP.fingerprints(docs.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_likeness_is_bounded_and_ranks_edits():
    a, b = prose(1, 400), prose(2, 400)
    da, db = FP.digest(a), FP.digest(b)
    near = FP.digest(a.replace("w1", "v1"))
    assert FP.likeness(da, da) == 1.0 and 0 <= FP.likeness(da, db) < FP.likeness(da, near) <= 1
    assert FP.digest("x" * (1 << 20) + "tail") != FP.digest("x" * (1 << 20) + "liat")


def test_statistics_equal_brute_force(spark, docs):
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules(docs.unionByName(docs.selectExpr("doc_id + 100 AS doc_id", "repeat(concat('a b c # d\\n', coalesce(text, ''), '\\n'), 2) AS text", *docs.columns[2:])), labels(spark)).collect()]
    texts = {}
    for r in docs.collect():
        texts[r["doc_id"]] = r["text"] or ""
        if r["doc_id"] is not None:
            texts[r["doc_id"] + 100] = ("a b c # d\n" + (r["text"] or "") + "\n") * 2
    for d, *facts in got:
        if d is None:
            continue
        t = texts[d]
        w = WORD.findall(t)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        at = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert facts == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at), len(w) < 50 or 100 * len(at) > 50 * len(w)], d


def test_rules_learn_to_reject_and_keep_the_clean(spark):
    rows, marks = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = prose(i, 90)
        rows.append((i, " ".join(f"{w}###" for w in text.split()) if bad else text, "en", "s", 1))
        marks.append((i, int(not bad), 0))
    df, y = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules(df, y).collect()}
    assert got == {i: i % 3 != 0 for i in range(300)}
    assert {r["doc_id"] for r in keep_good(df, y).collect()} == {i for i in range(300) if i % 3}
    assert all(r["kept"] or r["base_failed"] for r in quality_rules(df, y.limit(0)).collect())
    assert quality_rules(df.limit(0), y).count() == 0


def small_network():
    rng = np.random.default_rng(0)
    texts = [rng.integers(2, 12, n) for n in (4, 1, 7, 3)]
    return TextCNN(dims=3, filters=2, epochs=0, steps=0).fit(texts, np.array([1, 0, 1, 0], np.float32), 12), texts


def test_network_gradient_equals_differences():
    net, texts = small_network()
    rng = np.random.default_rng(5)
    net.p = {k: rng.normal(0, 0.5, v.shape) for k, v in net.p.items()}  # in double precision
    net.p["e"][0] = 0
    idx, starts = net.lay_out(texts)
    y = np.array([1.0, 0, 1, 0])
    _, g = net.gradients(idx, starts, y)
    for name, v in net.p.items():
        for at in np.ndindex(v.shape):
            if name == "e" and at[0] == 0:
                continue  # the pad is held at zero
            kept, two = v[at], []
            for step in (1e-6, -1e-6):
                v[at] = kept + step
                two.append(net.gradients(idx, starts, y)[0])
            v[at] = kept
            assert abs((two[0] - two[1]) / 2e-6 - g[name][at]) < 1e-6, (name, at)


def test_no_window_crosses_texts():
    net, texts = small_network()
    assert np.allclose(net.logits(texts), np.concatenate([net.logits([t]) for t in texts]), atol=1e-5)


def test_toxicity_learns_and_carries_rows(spark, docs):
    rows, marks = [], []
    for i in range(400):
        toxic = i % 5 == 1
        w = prose(i, 60).split()
        if toxic:
            for j in (5, 20, 40):
                w[j] = ("vile", "rotten", "foul")[(i + j) % 3]
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, int(toxic)))
    df, y = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity(df, y).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 1) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert set(got[0].asDict()) == {*df.columns, "held_out", "score", "predicted"}
    odd = toxicity(docs, labels(spark)).collect()
    assert len(odd) == docs.count()
    none = toxicity(docs, labels(spark).limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity(docs.limit(0), labels(spark)).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    ids = spark.range(9000).selectExpr("id AS doc_id", "xxhash64(id) AS h").orderBy("h").collect()
    late = {r["doc_id"] for r in ids[6000:]}  # rows that no bounded choice by this hash reaches
    rows = [(i, f"{prose(i, 12)} {('vile' if i in late else 'rotten') if i % 2 else 'fine'} {prose(i + 1, 6)}", "en", "s", 1) for i in range(9000)]
    df, y = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, i % 2) for i in range(9000)], "doc_id long, quality int, toxic int")
    usable = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 5]
    for few in (500_000, 0):  # labels broadcast, then shuffled
        monkeypatch.setattr(module, "BROADCAST_ROWS", few)
        model = module.train(df, y, learner=2500)
        assert {k: sum(n for (_, t), n in model.rows.items() if t == k) for k in (0, 1)} == {k: sum(i % 2 == k for i in usable) for k in (0, 1)}
        assert {module.hashed(w) for w in ("vile", "rotten", "fine")} <= set(model.known.tolist())
    held = [r for r in toxicity(df, y, learner=2500).collect() if r["held_out"]]
    for own in (late, set(range(9000)) - late):
        assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held if r["doc_id"] in own]) > 0.95


def shares(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, full, out = float(sum(sizes.values())), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            full.add(s)
            out[s] = cap * sizes[s]
            left -= out[s]


def test_mix_meets_targets(spark, docs):
    more = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(5000 + i, prose(i, 5 + i % 40), "en", ("s0", "s1", "s1", "s9")[i % 4], 1) for i in range(400)], DOCS))
    rows = mix(more).collect()
    size = Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["copies"] <= 3
        size[r["source"]] += r["size"]
    want, got = shares(size), Counter()
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == size[r["source"]]
        got[r["source"]] += r["copies"] * r["size"]
    longest = {s: max(r["size"] for r in rows if r["source"] == s) for s in size}
    for s, t in want.items():  # one document is nine tenths of s1, and copies are whole
        assert abs(got[s] - t) <= (max(0.02 * t, 80) if longest[s] < t / 2 else longest[s] / 2), (s, got[s], t)
    assert sorted((r["doc_id"] or -1, r["copies"]) for r in mix(more).collect()) == sorted((r["doc_id"] or -1, r["copies"]) for r in rows)
    assert mix(more.limit(0)).count() == 0


def test_shards_hold_near_equal_bytes_and_cut_hot_groups(spark, docs):
    hot = spark.createDataFrame([(9000 + i, "the same text " * 20, "en", "s", 1) for i in range(300)], DOCS)
    wide = spark.createDataFrame([(20000 + i, prose(i, 30), "en", "s", 1) for i in range(600)], DOCS)
    df = docs.filter("doc_id <> 23 OR doc_id IS NULL").select("doc_id", "text", "source").withColumnRenamed("source", "slot").unionByName(hot.unionByName(wide).selectExpr("doc_id", "text", "source AS slot"))
    for limit in (256 << 20, 4096):  # whole shards, and shards of several ranges
        rows = shard(df, 8, range_bytes=limit).collect()
        assert len(rows) == df.count()
        by = defaultdict(list)
        for r in rows:
            t = r["text"] or ""
            assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode())
            by[r["shard"]].append(r)
        assert set(by) == set(range(8))
        for part in by.values():
            assert sorted(r["slot"] for r in part) == list(range(len(part)))
        size = [sum(r["size"] for r in part) for part in by.values()]
        assert max(size) - min(size) <= 0.1 * np.mean(size)
    assert shard(df.limit(0), 8).count() == 0
