"""A convolutional text classifier for toxicity.

Words are hashed; those met in a few training texts get an embedding, all others share
one. Filters of widths 1, 2 and 3 slide over the whole text, each keeps its largest
response, and a logistic layer weighs them. It is trained in numpy by the tasks, on every
labelled row that may be used: each learner goes through its rows, and their parameters are
averaged after each round. A threshold for each language, which is told from the function
words of the text, turns the output into a score whose 0.5 is the threshold.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, only_cache, table, trim

#: Hash space of the words.
SPACE = 1 << 24
WIDTHS = (1, 2, 3)
PAD, RARE = 0, 1
#: Rows turned into Python objects at a time.
SLICE = 1000
#: Words a learner holds and shuffles at a time, and the most that one learner holds alone.
BUFFER, HELD = 2_000_000, 8_000_000
#: Parameters in a row of what learners send to be averaged.
CHUNK = 1 << 14
#: Outputs told apart in one unit of the logit where thresholds are set.
STEPS = 256
#: Up to this many labels are broadcast; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 500_000
_LETTERS = re.compile(r"[\W\d_]+")

# Frequent function words that tell four languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is that was for with this are you it by be from",
    "de": "der die und den von zu das mit sich des auf ist im dem nicht ein",
    "fr": "le et les des du une est dans qui au pour sur par pas plus ce",
    "es": "el los del las por con una su para como al lo más pero y se",
}
LANGUAGES = ("", *FUNCTION_WORDS)
_LANGUAGE = {w: i for i, k in enumerate(LANGUAGES) if i for w in FUNCTION_WORDS[k].split()}


def normal(word: str) -> str:
    """A word in lower case without anything but letters."""
    return _LETTERS.sub("", word.lower())


def hashed(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % SPACE


class _Codes(dict):
    """Raw word to index + (language << 24); forgets all at ``most`` words."""

    def __init__(self, index: dict[int, int] | None, most: int = 300_000):
        self.index, self.most = index, most

    def __missing__(self, raw: str) -> int:
        w = normal(raw)
        h = hashed(w)
        code = (h if self.index is None else self.index.get(h, RARE)) | _LANGUAGE.get(w, 0) << 24
        if len(self) >= self.most:
            self.clear()
        self[raw] = code
        return code


def _encode(codes: _Codes, text: str | None) -> tuple[np.ndarray, int]:
    """The indexes of a text's words, and its language."""
    raw = (text or "").split()
    x = np.fromiter(map(codes.__getitem__, raw), np.int64, len(raw))
    votes = np.bincount(x >> 24, minlength=len(LANGUAGES))
    return x & (SPACE - 1), int(votes[1:].argmax()) + 1 if votes[1:].any() else 0


@dataclass
class TextCNN:
    """``fit`` learns from (words, label); ``logits`` gives one number a text."""

    dims: int = 12
    filters: int = 12
    epochs: int = 12
    rounds: int = 5  # through many texts
    steps: int = 300  # at least, for few texts
    batch: int = 64
    rate: float = 0.01
    decay: float = 2e-3
    dropped: float = 0.5  # words hidden at random while training
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def _conv(self, x: np.ndarray, w: int) -> np.ndarray:
        n = len(x) - w + 1
        return sum(x[j : n + j] @ self.p[f"w{w}"][j] for j in range(w)) + self.p[f"b{w}"]

    @staticmethod
    def lay_out(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one row, each before two pads that no window crosses."""
        gap = np.zeros(max(WIDTHS) - 1, np.int64)
        starts = np.cumsum([0, *(len(t) + len(gap) for t in texts)])
        return np.concatenate([y for t in texts for y in (t, gap)] + [np.zeros(1, np.int64)]), starts

    def gradients(self, idx: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
        """The loss of laid-out texts, mean weighted cross entropy and half the squares of
        what is used times ``decay``, and its derivative by each parameter."""
        p, d, f = self.p, self.dims, self.filters
        x = p["e"][idx]
        pooled, argmax = [], []
        for w in WIDTHS:
            c = self._conv(x, w)
            where = np.stack([a + c[a : max(a + 1, z)].argmax(0) for a, z in zip(starts[:-1], starts[1:] - w + 1)])
            pooled.append(np.take_along_axis(c, where, 0))
            argmax.append(where)
        h = np.concatenate(pooled, 1)
        r = np.maximum(h, 0)
        z = np.clip(r @ p["u"] + p["c"], -30, 30)
        used = np.unique(idx[idx != PAD])
        loss = float(np.mean(weight * (np.logaddexp(0, z) - y * z))) + self.decay / 2 * float(sum((v**2).sum() for v in (p["u"], p["e"][used], *(p[f"w{w}"] for w in WIDTHS))))
        dz = (weight * (1 / (1 + np.exp(-z)) - y) / len(y)).astype(p["u"].dtype)
        g = {"u": r.T @ dz + self.decay * p["u"], "c": dz.sum(keepdims=True), "e": np.zeros_like(p["e"])}
        dh = dz[:, None] * p["u"] * (h > 0)
        for k, w in enumerate(WIDTHS):
            dk, where = dh[:, k * f : (k + 1) * f], argmax[k]
            g[f"b{w}"], g[f"w{w}"] = dk.sum(0), self.decay * p[f"w{w}"]
            for j in range(w):
                g[f"w{w}"][j] += np.einsum("bfd,bf->df", x[where + j], dk)
                np.add.at(g["e"], idx[where + j].ravel(), (dk[:, :, None] * p[f"w{w}"][j].T[None]).reshape(-1, d))
        g["e"][used] += self.decay * p["e"][used]
        g["e"][PAD] = 0
        return loss, g

    def start(self, vocabulary: int) -> TextCNN:
        """New parameters for that many words, the pad and the rare word among them."""
        rng = np.random.default_rng(self.seed)
        d, f = self.dims, self.filters
        p = self.p = {"e": rng.normal(0, 0.1, (vocabulary, d)).astype(np.float32), "u": rng.normal(0, 0.3, len(WIDTHS) * f).astype(np.float32), "c": np.zeros(1, np.float32)}
        p["e"][PAD] = 0
        for w in WIDTHS:
            p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * d), (w, d, f)).astype(np.float32)
            p[f"b{w}"] = np.zeros(f, np.float32)
        return self

    def passes(self, n: int) -> int:
        """How often ``n`` texts are gone through: ``epochs`` times up to 6,000, then
        less, ``rounds`` times at least; more for few texts."""
        return max(min(self.epochs, max(self.rounds, self.epochs * 6000 // max(1, n))), -(-self.steps * self.batch // max(1, n)))

    def dealt(self, texts: Sequence[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Once through the texts in random order, ``batch`` at a time, fewer if they are long."""
        own, n = [], 0
        for i in rng.permutation(len(texts)).tolist():
            if own and (len(own) >= self.batch or n + len(texts[i]) > 50_000):
                yield [texts[j] for j in own], labels[own]
                own, n = [], 0
            own.append(i)
            n += len(texts[i])
        if own:
            yield [texts[j] for j in own], labels[own]

    def learn(self, batches: Iterable[tuple[list[np.ndarray], np.ndarray]], rng: np.random.Generator, weights: Sequence[float] = (1.0, 1.0)) -> TextCNN:
        """A step of Adam for each batch; of the embedding, only words of the batch move."""
        p = self.p
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        taken = {k: np.zeros((len(v),) + (1,) * (v.ndim - 1), np.int32) for k, v in p.items()}
        place = np.zeros(len(p["e"]), np.int64)
        for texts, labels in batches:
            idx, starts = self.lay_out(texts)
            idx = np.where((idx != PAD) & (rng.random(len(idx)) < self.dropped), RARE, idx)
            used = np.flatnonzero(np.bincount(idx))  # the pad comes first
            place[used] = np.arange(len(used))
            _, g = replace(self, p=p | {"e": p["e"][used]}).gradients(place[idx], starts, labels, np.where(labels == 1, weights[1], weights[0]))
            for k, v in p.items():
                at = used if k == "e" else slice(None)
                taken[k][at] += 1
                t = taken[k][at].astype(np.float32)
                first[k][at] += 0.1 * (g[k] - first[k][at])
                second[k][at] += 0.001 * (g[k] ** 2 - second[k][at])
                v[at] -= self.rate * (first[k][at] / (1 - np.float32(0.9) ** t)) / (np.sqrt(second[k][at] / (1 - np.float32(0.999) ** t)) + np.float32(1e-8))
        return self

    def fit(self, texts: Sequence[np.ndarray], labels: np.ndarray, vocabulary: int) -> TextCNN:
        self.start(vocabulary)
        rng = np.random.default_rng(self.seed)
        return self.learn((b for _ in range(self.passes(len(texts))) for b in self.dealt(texts, labels, rng)), rng)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def unflat(self, x: np.ndarray) -> TextCNN:
        """A network of this one's shapes with the parameters of ``flat``."""
        cuts = np.cumsum([self.p[k].size for k in sorted(self.p)])[:-1]
        return replace(self, p={k: v.reshape(self.p[k].shape).copy() for k, v in zip(sorted(self.p), np.split(x, cuts))})

    def tables(self) -> dict[tuple[int, int], np.ndarray]:
        """Each filter's response to each word at each place: gathering these equals
        embedding and multiplying."""
        return {(w, j): self.p["e"] @ self.p[f"w{w}"][j] for w in WIDTHS for j in range(w)}

    def logits(self, texts: Sequence[np.ndarray], tables: dict[tuple[int, int], np.ndarray] | None = None) -> np.ndarray:
        t = tables or self.tables()
        idx, starts = self.lay_out(texts)
        pooled = []
        for w in WIDTHS:
            n = len(idx) - w + 1
            c = t[w, 0][idx[:n]]
            for j in range(1, w):
                c += t[w, j][idx[j : n + j]]
            ends = np.minimum(starts[1:] - w + 1, n)
            cuts = np.stack([starts[:-1], np.maximum(ends, starts[:-1] + 1)], 1).ravel()
            pooled.append(np.maximum.reduceat(np.concatenate([c, np.full((w, c.shape[1]), -np.inf, c.dtype)]), cuts, axis=0)[::2] + self.p[f"b{w}"])
        return np.maximum(np.concatenate(pooled, 1), 0) @ self.p["u"] + self.p["c"]


@dataclass
class Model:
    """What tasks need: the network, the known words' hashes in order and a threshold a
    language; and how many rows of each role (fit or not) and label it was made of."""

    net: TextCNN
    known: np.ndarray
    thresholds: list[float]
    rows: dict[tuple[bool, int], int]
    key: str


def _places(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The indexes of hashed words."""
    if not len(known):
        return np.full(len(x), RARE, np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at + 2, RARE)


def _threshold(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """Half-way inside the interval of cuts with the least error; ``z`` ascends, each with
    the number of clean and of toxic texts there."""
    below = np.concatenate([[0], np.cumsum(toxic)])  # toxic ones that a cut misses
    above = np.concatenate([[0], np.cumsum(clean)])
    error = below + above[-1] - above
    best = np.flatnonzero(error == error.min())
    k = int(best[len(best) // 2])
    return float((z[k - 1] + z[k]) / 2) if 0 < k < len(z) else float(z[0] - 1 if k == 0 else z[-1] + 1)


def _examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str] | None:
    """A scratch table of every labelled row that may be learnt from: toxic, fit (false for
    the fifth that sets the thresholds), language, the words' hashes and how many."""
    crc = F.crc32(F.col("doc_id").cast("string")) % 5
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(crc != 0)
    usable = usable.withColumn("fit", F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string"))) % 5 != 0)
    n = usable.count()
    if not n:
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("training", dict().clear)
        codes = _Codes(None)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                found = [_encode(codes, t) for t in piece.column("text").to_pylist()]
                packed = pa.array([x.astype("<u4").tobytes() for x, _ in found], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("toxic"), piece.column("fit"), pa.array([k for _, k in found], pa.int32()), packed, pa.array([len(x) for x, _ in found], pa.int64())], ["toxic", "fit", "language", "words", "n"])
        trim()

    some = docs.select("doc_id", "text").filter(crc != 0)
    joined = some.join(F.broadcast(usable) if n <= BROADCAST_ROWS else usable.hint("merge"), "doc_id").select("text", "toxic", "fit")
    return table(joined.mapInArrow(words, "toxic int, fit boolean, language int, words binary, n long"), "examples")


def _known(rows: DataFrame, least: dict[int, float]) -> np.ndarray:
    """The words that enough of the clean or of the toxic texts hold, counted over all."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), SLICE):
                piece = frame[at : at + SLICE]
                met = [np.unique(np.frombuffer(b, "<u4")) for b in piece["words"]]
                marked = np.concatenate([u.astype(np.int64) * 2 + y for u, y in zip(met, piece["toxic"])])
                w, n = np.unique(marked, return_counts=True)
                yield pd.DataFrame({"word": w >> 1, "clean": np.where(w & 1, 0, n), "toxic": np.where(w & 1, n, 0)})

    counted = rows.select("words", "toxic").mapInPandas(count, "word long, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    chosen = counted.filter((F.col("clean") >= least[0]) | (F.col("toxic") >= least[1])).select("word").toArrow()
    return np.sort(chosen["word"].to_numpy()).astype(np.uint32)


def _learnt(rows: DataFrame, learners: int, net: TextCNN, known: np.ndarray, weights: Sequence[float], n: int) -> TextCNN:
    """Trains on all ``rows``. One learner goes through its rows as often as need be; more
    go through theirs once a round, each in its own task and from the same parameters, whose
    average by rows is where the next round starts. Rows stream through a learner."""
    spark, passes = rows.sparkSession, net.passes(n)
    rounds, inner, held = (1, passes, None) if learners == 1 else (passes, 1, BUFFER)
    dealt = rows.select("words", "toxic", "n").coalesce(learners)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((net, known))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            only_cache("training", dict().clear)
            base, words = shared.value
            own = base.unflat(base.flat())
            rng = np.random.default_rng([own.seed, turn])
            seen = 0

            def batches() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
                nonlocal seen
                texts, y, size = [], [], 0

                def all_held() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
                    for _ in range(inner):
                        yield from own.dealt(texts, np.array(y, np.float32), rng)

                for frame in frames:
                    for b, label in zip(frame["words"], frame["toxic"]):
                        texts.append(_places(words, np.frombuffer(b, "<u4")).astype(np.int32))
                        y.append(label)
                        seen, size = seen + 1, size + len(texts[-1])
                        if held and size >= held:
                            yield from all_held()
                            texts, y, size = [], [], 0
                if texts:
                    yield from all_held()

            own.learn(batches(), rng, weights)
            if seen:
                x = own.flat()
                parts = [x[at : at + CHUNK].tobytes() for at in range(0, len(x), CHUNK)]
                yield pd.DataFrame({"chunk": range(len(parts)), "n": seen, "part": parts})
            trim()

        def average(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["n", "part"])
            total = sum(np.frombuffer(b, np.float32).astype(np.float64) * k for b, k in zip(frame["part"], frame["n"]))
            return pd.DataFrame({"chunk": frame["chunk"][:1], "part": [(total / frame["n"].sum()).astype(np.float32).tobytes()]})

        parts = dealt.mapInPandas(run, "chunk int, n long, part binary").groupBy("chunk").applyInPandas(average, "chunk int, part binary").collect()
        net = net.unflat(np.frombuffer(b"".join(bytes(r["part"]) for r in sorted(parts, key=lambda r: r["chunk"])), np.float32))
        shared.destroy()
    return net


def _thresholds(rows: DataFrame, net: TextCNN, known: np.ndarray, min_positives: int) -> list[float]:
    """From the outputs of all ``rows``, counted in steps of 1 / STEPS, a cut a language."""
    shared = rows.sparkSession.sparkContext.broadcast((net, known))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, known = shared.value
        tables = net.tables()
        for frame in frames:
            z = np.concatenate([net.logits([_places(known, np.frombuffer(b, "<u4"))], tables) for b in frame["words"]])
            yield pd.DataFrame({"language": frame["language"], "z": np.floor(np.clip(z, -60, 60) * STEPS).astype(np.int64), "toxic": frame["toxic"]})

    binned = rows.select("words", "language", "toxic").mapInPandas(run, "language int, z int, toxic int")
    got = binned.groupBy("language", "z").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).toPandas().sort_values("z")
    shared.destroy()

    def cut(own: pd.DataFrame) -> float:
        own = own.groupby("z", as_index=False)[["clean", "toxic"]].sum()
        return _threshold((own["z"].to_numpy() + 0.5) / STEPS, own["clean"].to_numpy(), own["toxic"].to_numpy())

    spoken = [got[got["language"] == k] for k in range(len(LANGUAGES))]
    common = cut(got)
    return [cut(own) if own["toxic"].sum() >= min_positives and own["clean"].sum() >= min_positives else common for own in spoken]


def train(docs: DataFrame, labels: DataFrame, *, learner: int = 8192, min_texts: int = 4, min_positives: int = 20) -> Model | None:
    """Learns from every labelled row whose crc32(doc_id as text) mod 5 is not 0: four
    fifths of them (by a hash of doc_id) give the words and the weights, the others the
    thresholds. A word is known if 1 in 1,200 of the clean texts or 1 in 300 of the toxic
    ones hold it, ``min_texts`` at least; such shares bound the vocabulary at any size. In
    the loss toxic texts weigh a third of all, or their own share if that is more. A learner
    gets about ``learner`` rows. None if either class is missing."""
    made = _examples(docs, labels)
    if made is None:
        return None
    examples, path = made
    count = examples.groupBy("fit", "toxic").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    rows = {(r["fit"], r["toxic"]): r["rows"] for r in count}
    clean, toxic = (rows.get((True, y), 0) for y in (0, 1))
    if not clean or not toxic:
        discard(docs.sparkSession, path)
        return None
    fit, n = examples.filter("fit"), clean + toxic
    known = _known(fit, {0: max(min_texts, clean / 1200), 1: max(min_texts, toxic / 300)})
    few = n <= learner and sum(r["n"] for r in count if r["fit"]) <= HELD
    share = max(toxic / n, 1 / 3)  # of the loss
    weights = ((1 - share) * n / clean, share * n / toxic)
    net = _learnt(fit, 1 if few else max(2, -(-n // learner)), TextCNN().start(len(known) + 2), known, weights, n)
    thresholds = _thresholds(examples.filter("NOT fit") if all((False, y) in rows for y in (0, 1)) else fit, net, known, min_positives)
    discard(docs.sparkSession, path)
    return Model(net, known, thresholds, rows, f"{zlib.crc32(net.p['e'].tobytes()):08x}{len(known)}")


_held: dict[str, tuple[_Codes, dict[tuple[int, int], np.ndarray]]] = {}  # of the worker's last model


def toxicity(df: DataFrame, labels: DataFrame, **how: int) -> DataFrame:
    """Adds held_out (crc32(doc_id as text) mod 5 is 0), score (0 to 1) and predicted (1
    from a score of 0.5 on) to every row of ``df``, whose other columns stay. Training
    takes all ``labels``: doc_id, toxic (0 or 1); see ``train``.

    The score reads the whole text and nothing else; a null or empty text is scored as
    no words. Without both classes every score is 0. A doc_id labelled twice counts as
    toxic if one label does. Rows may repeat; an empty table gives no row; a column named
    like an added one is replaced.
    """
    df = df.drop(*(c for c in ("held_out", "score", "predicted") if c in df.columns))
    model = train(df, labels, **how)
    give_back()
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("toxicity", _held.clear)
        m = shared.value
        if m is not None and m.key not in _held:
            _held.clear()
            _held[m.key] = (_Codes({w: i + 2 for i, w in enumerate(m.known.tolist())}), m.net.tables())
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                piece = batch.slice(begin, SLICE)
                scores = np.zeros(piece.num_rows)
                if m is not None:
                    codes, tables = _held[m.key]
                    texts, n, at = [], 0, 0
                    for i, t in enumerate(piece.column("text")):
                        texts.append(_encode(codes, t.as_py()))
                        n += len(texts[-1][0])
                        if n >= 50_000 or i + 1 == piece.num_rows:
                            z = m.net.logits([x for x, _ in texts], tables) - np.array([m.thresholds[k] for _, k in texts])
                            scores[at : i + 1] = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                            texts, n, at = [], 0, i + 1
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(scores)], [*keep, "score"])
        trim()

    # The text need not come back where there is nothing else to carry.
    keep = ["doc_id"] if set(columns) == {"doc_id", "text"} else columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    scored = df.mapInArrow(run, f"{types}, score double")
    crc = F.crc32(F.col("doc_id").cast("string")) % 5
    return scored.withColumn("held_out", F.coalesce(crc == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
