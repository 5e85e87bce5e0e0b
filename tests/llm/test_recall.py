from helpers import DOCS, prose

from chiweave.llm.near_duplicates import found_share, ngram_join


def changed(text, marks):
    w = text.split()
    for at, mark in marks:
        w[at] = mark
    return " ".join(w)


def test_a_hot_group_pays_for_no_other_links(spark):
    hot = prose(1, 400)
    rows = [(i, changed(hot, [(10 + i, f"hot{i}")]), "en", "s", 1) for i in range(300)]
    for i in range(120):  # pairs of similarity 90 / 110
        text = prose(1000 + i, 104)
        rows += [(1000 + 2 * i, text, "en", "s", 1), (1001 + 2 * i, changed(text, [(30, f"a{i}"), (70, f"b{i}")]), "en", "s", 1)]
    found = ngram_join(spark.createDataFrame(rows, DOCS))
    assert found_share(0.8, found.depth) >= 0.9995
    links = {r["doc_id"]: r["n_links"] for r in found.documents.collect()}
    assert links == {i: 299 for i in range(300)} | {1000 + i: 1 for i in range(240)}


def test_a_hot_group_joins_without_a_shuffle_of_its_rows(spark):
    from chiweave.llm.common import skewed_join

    big = spark.range(9000).selectExpr("CASE WHEN id < 6000 THEN 1 ELSE id END AS k", "id AS v")
    small = big.groupBy("k").count().selectExpr("k", "k * 2 AS m", "count AS weight")
    got = {(r["k"], r["v"], r["m"]) for r in skewed_join(big, small, "k", 9000).collect()}
    assert got == {(1 if i < 6000 else i, i, 2 if i < 6000 else 2 * i) for i in range(9000)}


def test_every_candidate_can_be_verified(spark):
    from helpers import prose

    words = [prose(i, 60).split() for i in range(30)]
    rows = [(3 * i + k, " ".join(w[: 60 - 2 * k])) for i, w in enumerate(words) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for d, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    for margin in (None, 4.0):
        links = ngram_join(df, links=True, margin=margin).links.collect()
        assert {(r["a"], r["b"]) for r in links} == want and want
