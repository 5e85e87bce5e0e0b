"""Encoding with the tokenizers library, one word at a time.

A byte-level pre-tokenizer never joins two words across a single space, and takes a
comma or full stop after a letter at a word's end for a piece of its own. So the ids of a
text are those of its first word followed by those of each " word". The words of many
texts are found and told apart in numpy, by hashes whose members are then compared byte by
byte; each worker keeps the ids of words it has met, by the words themselves; new words go
to the library as one text, whose ids are cut where a token begins with the space. Anything
irregular at a word's edge (two spaces, other white space, a special token), and a word
whose hash belongs to another word, sends the whole text to the library.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from .common import only_cache

#: Bytes hashed at a time; longer texts go to the library whole.
MOST = 2 << 20
_rng = np.random.default_rng(11)
_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C17 | 3
_FIRST = np.uint64(0x5851F42D4C957F2D)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARKS = b",."
#: Masks of the first 0 to 8 bytes of a little-endian word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and of its inverse."""
    out = []
    for base in (_BASE % (1 << 64), pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _differ(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Which of the words x[starts:ends] are not the very bytes of the word ``like`` them."""
    size = ends - starts
    out = size != size[like]
    todo = np.flatnonzero((like != np.arange(len(like))) & ~out & (size > 0))
    a, b, n = starts[todo], starts[like[todo]], size[todo]
    padded = np.append(x, np.zeros(8, np.uint8))
    eights = np.lib.stride_tricks.as_strided(padded, (len(x), 8), (1, 1))  # 8 bytes from each place
    low = _LOW[np.minimum(n, 8)]
    while len(todo):
        unequal = ((eights[a].view("<u8")[:, 0] ^ eights[b].view("<u8")[:, 0]) & low) != 0
        out[todo[unequal]] = True
        more = ~unequal & (n > 8)
        todo, a, b, n = todo[more], a[more] + 8, b[more] + 8, n[more] - 8
        low = _LOW[np.minimum(n, 8)]
    return out


class Encoder:
    """Texts to ids, as bytes of little-endian ``dtype``; always equal to the library's
    ``encode(text, add_special_tokens=False).ids``. Words not met among the last
    ``max_words`` new ones are forgotten. A ``dtype`` too small for the vocabulary raises."""

    def __init__(self, path: str, dtype: str = "<u4", max_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        if hasattr(self.lib.model, "_resize_cache"):
            self.lib.model._resize_cache(0)  # ours keeps every word; the library's only costs
        self.dtype, self.max_words = np.dtype(dtype), max_words
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.by_word = "ByteLevel(add_prefix_space=False" in str(self.lib.pre_tokenizer) and self.lib.normalizer is None and not any(" " in t for t in self.special)
        vocabulary = self.lib.get_vocab()
        if max(vocabulary.values()) > np.iinfo(self.dtype).max:
            raise ValueError(f"ids up to {max(vocabulary.values())} do not fit {self.dtype}")
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with the space
        self.opens[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True
        self.code = {1: "B", 2: "H", 4: "I"}[self.dtype.itemsize]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks = [self._alone(chr(m)) for m in _MARKS]

    def _alone(self, text: str) -> bytes:
        return array(self.code, self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def _regular(self, word: str) -> bool:
        if not word:
            return False
        a, z = word[0], word[-1]
        return a > " " and z > " " and not a.isspace() and not z.isspace() and not any(s in word for s in self.special)

    def _spaced(self, words: list[bytes]) -> list[bytes]:
        """The ids of " word" for each of the regular words."""
        if not words:
            return []
        text = (b" " + b" ".join(words)).decode("utf-8", "surrogatepass")
        ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(words):  # never seen; then one by one
            return [self._alone(" " + w.decode("utf-8", "surrogatepass")) for w in words]
        flat, k = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        at *= k
        ends = np.append(at[1:], len(flat)).tolist()
        return [flat[a:z] for a, z in zip(at.tolist(), ends)]

    def _ids(self, words: list[bytes], plain: list[bool]) -> list[bytes]:
        """The ids of each of these words, b"" for irregular ones. A word that no space
        precedes comes with one in front, which no word holds itself; ``plain`` tells the
        others that are regular for sure."""
        young = self.young
        found = list(map(young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new: list[int] = []
            for i in missing:
                x = self.old.get(words[i])
                if x is None:
                    new.append(i)
                else:
                    found[i] = young[words[i]] = x
            spaced = []
            for i in new:
                w = words[i]
                if w[:1] == b" ":
                    t = w[1:].decode("utf-8", "surrogatepass")
                    found[i] = self._alone(t) if self._regular(t) else b""
                elif plain[i] or self._regular(w.decode("utf-8", "surrogatepass")):
                    spaced.append(i)
                else:
                    found[i] = b""
            for i, x in zip(spaced, self._spaced([words[i] for i in spaced])):
                found[i] = x
            young.update((words[i], found[i]) for i in new)
            if len(young) > self.max_words:
                self.old, self.young = young, {}
        return found

    def _block(self, raw: list[bytes], texts: list[str]) -> list[bytes]:
        buf = b" ".join(raw) + b" "
        x = np.frombuffer(buf, np.uint8)
        power, inverse = _powers(MOST + 1)
        ends = np.flatnonzero(x == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        text_at = np.cumsum([0, *(len(r) + 1 for r in raw)])
        first_word = np.searchsorted(starts, text_at)  # of each text, and one past all
        is_first = np.zeros(len(starts), bool)
        is_first[first_word[:-1]] = True
        # A comma or full stop that ends a word after an ASCII letter is taken off.
        long = ends - starts >= 2
        last, before = x[np.maximum(ends - 1, 0)], x[np.maximum(ends - 2, 0)]
        mark = np.where(long & _LETTER[before] & ~is_first, np.where(last == _MARKS[0], 1, np.where(last == _MARKS[1], 2, 0)), 0)
        cut = ends - (mark > 0)
        sums = np.zeros(len(x) + 1, np.uint64)
        for at in range(0, len(x), 1 << 15):  # what the processor's cache holds
            v = _VALUE[x[at : at + (1 << 15)]]
            v *= power[at : at + len(v)]
            v[:1] += sums[at : at + 1]
            np.cumsum(v, out=sums[at + 1 : at + 1 + len(v)])
        h = (sums[cut] - sums[starts]) * inverse[starts] + (cut - starts).astype(np.uint64)
        h[is_first] ^= _FIRST
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        differs = _differ(x, starts, cut, one[which])
        edge_a, edge_z = x[starts[one]], x[np.maximum(cut[one] - 1, 0)]
        plain = (edge_a > 32) & (edge_a < 127) & (edge_z > 32) & (edge_z < 127) & (cut[one] > starts[one])
        if any(t.encode() in buf for t in self.special):
            plain[:] = False
        met = [b" " + buf[a:z] if f else buf[a:z] for a, z, f in zip(starts[one].tolist(), cut[one].tolist(), is_first[one].tolist())]
        ids = self._ids(met, plain.tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        broken = np.logical_or.reduceat((size == 0)[which] | differs, first_word[:-1])
        # Words and the marks after them in order: units, each a slice of the flat ids.
        units = np.repeat(which, 1 + (mark > 0))
        at_word = np.arange(len(which)) + np.cumsum(mark > 0) - (mark > 0)
        marked = np.flatnonzero(mark)
        units[at_word[marked] + 1] = len(ids) + mark[marked] - 1
        size = np.append(size, [len(m) // self.dtype.itemsize for m in self.marks])
        flat = np.frombuffer(b"".join(ids) + b"".join(self.marks), self.dtype)
        start = np.cumsum(size) - size
        n = size[units]
        end = np.cumsum(n)
        got = flat[np.repeat(start[units] - (end - n), n) + np.arange(int(end[-1]))]
        begin = np.append((end - n)[at_word[first_word[:-1]]], end[-1]).tolist()
        return [self._alone(t) if bad and t else got[p:q].tobytes() for t, bad, p, q in zip(texts, broken.tolist(), begin, begin[1:])]

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        out: list[bytes] = []
        raw: list[bytes] = []
        held: list[str] = []
        total = 0
        for t in texts:
            r = t.encode("utf-8", "surrogatepass")
            if not self.by_word or len(r) >= MOST:
                out += self._block(raw, held) if held else []
                out.append(self._alone(t))
                raw, held, total = [], [], 0
                continue
            if held and total + len(r) + 1 > MOST:
                out += self._block(raw, held)
                raw, held, total = [], [], 0
            raw.append(r)
            held.append(t)
            total += len(r) + 1
        return out + (self._block(raw, held) if held else [])


@lru_cache(maxsize=1)
def _kept(path: str, dtype: str) -> Encoder:
    return Encoder(path, dtype)


def _forget() -> None:
    _kept.cache_clear()
    _powers.cache_clear()


def shared_encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One encoder a worker process, so that its words outlive a task."""
    only_cache("tokens", _forget)
    return _kept(path, dtype)


def blocks(texts: Sequence[str | None], chars: int = 1_000_000):
    """(first, end) of runs of texts of about ``chars`` characters together."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
