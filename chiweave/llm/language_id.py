"""Language of web pages by Bayesian evidence fusion.

A page's text gives a likelihood for each language (hashed byte triplets, counted over
all documents of known language). Declared markup language and address suffix give two
more, from tables of how often each value meets each language, and the page's host
gives the prior, smoothed towards its domain and that towards the whole; all three are
grouped sums of the pages' text posteriors, each page's own part left out of its prior.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .html_extraction import page_blocks

BUCKETS = 1 << 14
#: Neighbouring triplets overlap, so each counts for a third of an observation.
OVERLAP = 3
#: Strength of the smoothing, in pages.
KAPPA = 10.0
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", re.I)
_PATH = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[-_][a-zA-Z]+)?(?:[/?#]|$)")


def triplets(text: str) -> np.ndarray:
    """Hashed byte triplets of a text in lower case, white space as one space."""
    x = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    h = x[:-2] * np.uint32(2654435761) + x[1:-1] * np.uint32(2246822519) + x[2:] * np.uint32(3266489917)
    return (h ^ (h >> np.uint32(15))) >> np.uint32(18)


def text_model(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of ``documents`` (text, lang) and the log chance of each triplet in
    each, (BUCKETS, languages), from all rows with a language."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                if text:
                    counts[lang] += np.bincount(triplets(text), minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    rows = documents.filter("lang IS NOT NULL").select("lang", "text").mapInPandas(count, "lang string, bucket int, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS a language at most
    langs = sorted({r["lang"] for r in found})
    n = np.ones((BUCKETS, len(langs)))
    for r in found:
        n[r["bucket"], langs.index(r["lang"])] += r["n"]
    return langs, np.log(n / n.sum(0))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _of(values: list[Column], combine) -> Column:
    out = values[0]
    for v in values[1:]:
        out = combine(out, v)
    return out


def language_id(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The language of every page of ``pages`` (page_id, url, html): page_id, url, host,
    declared (of the markup), suffix (two letters that open the path, else the top-level
    domain), text_lang (by text alone), lang and probability (0 to 1).

    ``documents`` (text, lang) teaches the text model; where it has no language, lang and
    probability are null. A page without text is judged by the rest; a null url is a
    host of its own; equal chances go to the first language in order; repeated rows are
    separate pages; other columns are not read; an empty table gives no row.
    """
    spark = pages.sparkSession
    langs, logs = text_model(documents)
    out = ["page_id", "url", "host", "declared", "suffix"]
    shared = spark.sparkContext.broadcast(logs.astype(np.float32))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = shared.value
        for frame in frames:
            declared, suffix, p = [], [], []
            for url, html in zip(frame["url"], frame["html"]):
                m = _DECLARED.search(html or "")
                declared.append(m[1].lower() if m else None)
                m = _PATH.match(url or "")
                suffix.append(m[1].lower() if m else None)
                blocks = page_blocks(html)
                main = " ".join(t for r, t in blocks if r != "chrome")
                x = triplets(main) if main else np.zeros(0, np.uint32)
                p.append((_softmax(table_[x].sum(0, dtype=np.float64) / OVERLAP) if len(x) and langs else np.full(len(langs), 1 / max(1, len(langs)))).tolist())
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "declared": declared, "suffix": suffix, "p": p})

    seen, _ = table(pages.select("page_id", "url", "html").mapInPandas(score, "page_id long, url string, declared string, suffix string, p array<double>"), "page-scores")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))
    seen = seen.withColumn("host", host).withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0))
    seen = seen.withColumn("suffix", F.coalesce("suffix", F.regexp_extract("host", r"[^.]*$", 0)))
    if not langs:
        return seen.select(*out, *(F.lit(None).cast(t).alias(c) for c, t in (("text_lang", "string"), ("lang", "string"), ("probability", "double"))))
    k = range(len(langs))
    p = [F.col("p")[i] for i in k]
    sums = lambda by, tag: seen.groupBy(by).agg(*(F.sum(p[i]).alias(f"{tag}{i}") for i in k))
    total = [float(x or 0) for x in seen.agg(*(F.sum(p[i]) for i in k)).collect()[0]]
    every = sum(total) or 1.0
    whole = [(t + 1) / (every + len(langs)) for t in total]

    small = lambda df: F.broadcast(df) if df.count() <= 200_000 else df
    joined = seen
    for by, tag in (("host", "h"), ("domain", "d"), ("declared", "m"), ("suffix", "s")):
        counted, _ = table(sums(by, tag), f"by-{by}")
        joined = joined.join(small(counted.filter(F.col(by).isNotNull())), by, "left")
    n = lambda tag: _of([F.coalesce(F.col(f"{tag}{i}"), F.lit(0.0)) for i in k], lambda a, b: a + b)
    rest = lambda tag, i: F.greatest(F.lit(0.0), F.coalesce(F.col(f"{tag}{i}"), F.lit(0.0)) - p[i])
    joined = joined.withColumns({f"nd_{i}": (rest("d", i) + KAPPA * whole[i]) / (F.greatest(F.lit(0.0), n("d") - 1) + KAPPA) for i in k})
    joined = joined.withColumns({f"prior_{i}": (rest("h", i) + KAPPA * F.col(f"nd_{i}")) / (F.greatest(F.lit(0.0), n("h") - 1) + KAPPA) for i in k})

    def meets(tag: str, value: str, i: int) -> Column:
        """Log chance of the value in language i, its own page left out, smoothed by the value's share."""
        share = F.greatest(F.lit(1e-6), (n(tag) - 1) / every)
        return F.when(F.col(value).isNull(), F.lit(0.0)).otherwise(F.log((rest(tag, i) + KAPPA * share) / (total[i] + KAPPA)))

    z = [F.log(F.greatest(p[i], F.lit(1e-30))) + F.log("prior_%d" % i) + meets("m", "declared", i) + meets("s", "suffix", i) for i in k]
    joined = joined.withColumn("z", F.array(*z)).withColumn("top", F.array_max("z"))
    norm = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    name = F.array(*(F.lit(x) for x in langs))
    best = lambda values, most: F.element_at(name, F.array_position(values, most).cast("int"))
    return joined.select(*out, best(F.col("p"), F.array_max("p")).alias("text_lang"), best(F.col("z"), F.col("top")).alias("lang"), (1 / norm).alias("probability"))
