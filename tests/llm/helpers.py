"""Small tables with every awkward case the operators must define a result for."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(i, n=80):
    rng = random.Random(i)
    return " ".join(f"w{rng.randrange(5003)}" for _ in range(n))


def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns
    whose names clash with what the operators add."""
    long = " ".join(f"z{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(i, prose(i), "en", f"s{i % 3}", 1) for i in range(20)]
    rows += [(20, None, None, None, None), (21, "", "en", "s0", 0), (22, " \n\t ", "en", "s0", 0), (23, long, "en", "s1", len(long)), (24, prose(3), "en", "s2", 1), (25, prose(3), "en", None, 1), (26, "Ünï <|endoftext|> 日本  x", "de", "s0", 1)]
    rows += [(27, prose(4) + " end", "en", "s0", 1), (None, "no id " + prose(50), "en", "s0", 1), (28, prose(28), "en", "s0", 1), (28, prose(28), "en", "s0", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("size", "hash", "range", "slot", "score", "key", "kept", "n_words", "rate", "part"):
        df = df.selectExpr("*", f"'own {c}' AS {c}")
    return df


def labels(spark, n=400):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(n)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
