"""The decision list and the language evidence against plain Python."""

import math
from collections import defaultdict

import numpy as np
from helpers import prose

from chiweave.llm import language_id as L
from chiweave.llm import quality as Q

PYTHON = {
    "words": lambda r: r["n_words"],
    "chars_per_word": lambda r: r["word_chars"] / max(r["n_words"], 1),
    "symbols_per_word": lambda r: r["n_symbols"] / max(r["n_words"], 1),
    "duplicate_lines": lambda r: r["n_dup_lines"] / max(r["n_lines"], 1),
    "repeated_words": lambda r: r["n_repeat_words"] / max(r["n_words"], 1),
    "upper_case": lambda r: r["n_upper"] / max(r["word_chars"], 1),
}


def test_the_list_is_grown_by_gain_and_applied_in_order(spark):
    rows, marks = [], []
    for i in range(600):
        w = prose(i, 60).split()
        bad = i % 4 == 0
        if bad:
            w = [x + "###" for x in w] if i % 8 else [x.upper() for x in w]
        rows.append((i, " ".join(w)))
        marks.append((i, int(not bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    stats = Q.text_statistics(df).drop("text")
    labelled = stats.join(labels.selectExpr("doc_id", "1 - quality AS bad"), "doc_id")
    rules = Q.learn_decision_list(labelled)
    assert len(rules) >= 2
    table = [r.asDict() for r in labelled.collect()]
    grow = [r for r in table if Q_part(r["doc_id"])]

    def holds(x, r):
        v = PYTHON[x.feature](r)
        return v > x.cut if x.above else v <= x.cut

    # The first literal gains most of all thresholds between values, on the growing part.
    total = sum(r["bad"] for r in grow), sum(1 - r["bad"] for r in grow)

    def gain(covers):
        p, n = sum(r["bad"] for r in covers), sum(1 - r["bad"] for r in covers)
        return p * (math.log2(p / (p + n)) - math.log2(total[0] / sum(total))) if p else 0.0

    best = 0.0
    for f in PYTHON.values():
        values = sorted({f(r) for r in grow})
        for a, b in zip(values, values[1:]):
            for covers in ([r for r in grow if f(r) <= (a + b) / 2], [r for r in grow if f(r) > (a + b) / 2]):
                best = max(best, gain(covers))
    assert gain([r for r in grow if holds(rules[0][0], r)]) >= 0.95 * best  # cuts are quantiles
    got = {r["doc_id"]: r for r in Q.quality_rules(df, labels).collect()}
    for r in table:
        first = next((i for i, rule in enumerate(rules, 1) if all(holds(x, r) for x in rule)), 0)
        assert got[r["doc_id"]]["rule"] == first and got[r["doc_id"]]["kept"] == (first == 0)
    assert sum(got[i]["kept"] != bool(good) for i, good in marks) <= 6


def Q_part(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 3 != 0


def test_language_evidence_equals_plain_python(spark):
    en, de = "the cat and the dog are in the house ", "der hund und die katze sind im haus "
    docs = [(en * 9, "en"), (de * 9, "de"), (en * 2, "en")]
    pages = [(i, f"https://www.{h}/{p}/{i}", f'<html lang="{d}"><body><article><p>{t}</p></article></body></html>') for i, (h, p, d, t) in enumerate([("a.org", "en", "en", en), ("a.org", "en", "de", en * 2), ("a.org", "x", "en", ""), ("b.de", "de", "de", de), ("b.de", "en", "de", de + en), ("c.org", "de", "fr", de)])]
    got = {r["page_id"]: r for r in L.language_id(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "text string, lang string")).collect()}

    langs = ["de", "en"]
    counts = {k: np.ones(L.BUCKETS) for k in langs}
    for t, k in docs:
        for x in L.triplets(t):
            counts[k][x] += 1
    logs = {k: np.log(v / v.sum()).astype(np.float32).astype(float) for k, v in counts.items()}
    rows = []
    for i, url, html in pages:
        text = html.split("<p>")[1].split("</p>")[0].strip()
        z = np.array([sum(logs[k][x] for x in L.triplets(text)) / L.OVERLAP for k in langs]) if text else np.zeros(2)
        e = np.exp(z - z.max())
        host, path = url.split("/")[2], url.split("/")[3]
        rows.append({"id": i, "p": e / e.sum(), "host": host, "domain": ".".join(host.split(".")[-2:]), "declared": html.split('"')[1], "suffix": path if len(path) == 2 else host.split(".")[-1]})
    total = sum(r["p"] for r in rows)
    every = total.sum()
    whole = (total + 1) / (every + 2)
    sums = {by: defaultdict(lambda: np.zeros(2)) for by in ("host", "domain", "declared", "suffix")}
    for r in rows:
        for by, s in sums.items():
            s[r[by]] = s[r[by]] + r["p"]
    for r in rows:
        others = {by: np.maximum(0, sums[by][r[by]] - r["p"]) for by in sums}
        domain = (others["domain"] + L.KAPPA * whole) / (max(0, sums["domain"][r["domain"]].sum() - 1) + L.KAPPA)
        prior = (others["host"] + L.KAPPA * domain) / (max(0, sums["host"][r["host"]].sum() - 1) + L.KAPPA)
        z = np.log(np.maximum(r["p"], 1e-30)) + np.log(prior)
        for by in ("declared", "suffix"):
            share = max(1e-6, (sums[by][r[by]].sum() - 1) / every)
            z += np.log((others[by] + L.KAPPA * share) / (total + L.KAPPA))
        chance = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r["id"]]["lang"] == langs[int(z.argmax())] and abs(got[r["id"]]["probability"] - chance.max()) < 1e-6, r["id"]
