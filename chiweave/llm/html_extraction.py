"""Main text of web pages by host suffix arrays.

A page is parsed once into blocks of text, each with a role: "article" inside an article
element, "chrome" inside menus, headers, footers, sidebars, adverts, forms and the like
(dropped at once), "hint" where only a class or id names such a thing, and "body" for the
rest. What a host repeats is site furniture: whole blocks are counted by their hashes, and
long runs of tokens inside blocks by suffix arrays over the host's pages. Copies of a page
count once.

All counts are of a whole host, however its pages are dealt. Every run of ``LEAST`` tokens
holds an anchor, the run of ``ANCHOR`` tokens in it with the least hash, and equal runs
hold equal anchors. So anchors are counted first, by a grouped aggregation; only blocks
with an anchor that is frequent on its host go into suffix arrays; each array reports every
run around such an anchor, and the reports are added up.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, only_cache, run_hashes, table

# Element names and the words in class, id or role that tell them apart.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button datalist map".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"br"}
COMMENTS = frozenset(("comment", "comments"))
HINTS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header menu nav navbar navigation newsletter notice notices pagination popup promo related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
PLAIN = frozenset("area bar block box button buttons column container content global icon icons inner item items js large left link links list main modal outer overlay page panel post posts article articles primary right secondary section site slot small sticky tag tags text title top bottom unit wrap wrapper".split())
HOLDERS = frozenset("div section ul ol table details".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def _named(attrs: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a class or id is one of ``words``, alone or with parts that say no more:
    "cookie-notice" and "site-footer" are, "share-price" and "media-widget" are not."""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = [p for p in map(str.lower, _PARTS.split(name)) if p]
        if any(p in words for p in parts) and all(p in HINTS or p in PLAIN or not p.isalpha() for p in parts):
            return True
    return False


class _Blocks(HTMLParser):
    """Blocks (role, text) of a page in order; tolerates unclosed and stray tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []  # element, role from there on
        self.blocks: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.role = "body"
        self.has_article = False

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text and self.role != "silent":
            self.blocks.append((self.role, text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P and any(t == "p" for t, _ in self.open):
            self._close_within("p")
        if tag == "li":
            self._close_within("li")
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        role = self.role
        if role != "silent":
            a = {k: v or "" for k, v in attrs}
            hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))
            if tag in SILENT or hidden:
                role = "silent"
            elif role != "chrome":
                inside = role == "article"
                if tag in CHROME and not (inside and tag == "header") or a.get("role") in ROLES:
                    role = "chrome"
                elif role == "hint":
                    pass
                elif tag in ("article", "main") or a.get("role") in ("main", "article") or a.get("itemprop") == "articleBody":
                    role = "chrome" if _named(a, COMMENTS) else "article"
                elif tag in HOLDERS and _named(a, HINTS - {"header"} if inside else HINTS) or not inside and tag in ("p", "span") and _named(a, HINTS):
                    role = "chrome" if inside else "hint"
        if role != self.role:
            self.flush()
        self.has_article |= role == "article"
        self.open.append((tag, self.role))
        self.role = role

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            self._close(tag)
        elif tag in BLOCKS:
            self.flush()

    def _close(self, tag: str) -> None:
        while self.open:
            t, role = self.open.pop()
            if t in BLOCKS or role != self.role:
                self.flush()
            self.role = role
            if t == tag:
                break

    def _close_within(self, tag: str) -> None:
        """Closes an open ``tag`` unless a container has been opened inside it."""
        for t, _ in reversed(self.open):
            if t == tag:
                self._close(tag)
                return
            if t in BLOCKS and t != "p":
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def _parsed(html: str | None) -> _Blocks:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser


def all_blocks(html: str | None) -> list[tuple[str, str]]:
    """(role, text) blocks of a page in order. White space inside a block is one space."""
    return _parsed(html).blocks


def page_blocks(html: str | None) -> list[tuple[str, str]]:
    """(role, text) blocks of a page: those of its articles if it has any, else those of
    its body, with chrome in both marked."""
    parser = _parsed(html)
    drop = {"body": "body"} if parser.has_article else {}
    return [("chrome" if role == "hint" else role, text) for role, text in parser.blocks if role not in drop]


def suffix_array(x: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Start positions in the order of their suffixes, by doubling; of their first
    ``depth`` values only, if that is given."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - step)] = rank[step:]
        order = np.lexsort((second, rank))
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)])) if n else 0
        rank = new
        step *= 2
        if not n or rank.max() == n - 1 or depth is not None and step >= depth:
            return order


def common_prefixes(x: np.ndarray, order: np.ndarray, most: int | None = None) -> np.ndarray:
    """Length of the common prefix of each suffix in the array and the one before it, up
    to ``most``."""
    n = len(x)
    out = np.zeros(n, np.int64)
    todo = np.arange(1, n)
    while len(todo) and (most is None or out[todo[0]] < most):
        a, b, k = order[todo - 1], order[todo], out[todo[0]]
        fits = np.maximum(a, b) + k < n
        todo, a, b = todo[fits], a[fits], b[fits]
        todo = todo[x[a + k] == x[b + k]]
        out[todo] += 1
    return out


def _runs(pages: Sequence[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pages' streams, joined with a unique end after each: the positions in the
    order of their suffixes, a number that suffixes with equal first ``least`` tokens share, and on
    how many pages each number's run stands. Runs that pass an end are alone."""
    owner = np.repeat(np.arange(len(pages)), [len(p) + 1 for p in pages])
    ends = np.cumsum([len(p) + 1 for p in pages]) - 1
    x = np.zeros(len(owner), np.int64)
    inside = np.ones(len(x), bool)
    inside[ends] = False
    tokens = np.concatenate(pages) if len(pages) else np.zeros(0, np.int64)
    x[inside] = np.unique(tokens, return_inverse=True)[1]
    x[ends] = len(tokens) + np.arange(len(ends))
    order = suffix_array(x, least)
    number = np.cumsum(common_prefixes(x, order, least) < least) - 1
    both = np.unique(number * len(pages) + owner[order]) if len(x) else np.zeros(0, np.int64)
    return order, number, np.bincount(both // max(1, len(pages)))


def covered_tokens(pages: Sequence[Sequence[int]], least: int, min_pages: int) -> list[np.ndarray]:
    """For each page's token ids, which tokens lie in a run of ``least`` or more that
    stands on ``min_pages`` or more of the pages."""
    order, number, n = _runs([np.asarray(p, np.int64) for p in pages], least)
    marks = np.zeros(len(order) + least + 1, np.int64)
    at = order[n[number] >= min_pages] if len(order) else order
    np.add.at(marks, at, 1)
    np.add.at(marks, at + least, -1)
    covered = np.cumsum(marks)[: len(order)] > 0
    ends = np.cumsum([len(p) + 1 for p in pages])
    return [covered[e - len(p) - 1 : e - 1] for e, p in zip(ends, pages)]


LEAST, ANCHOR, MIN_PAGES, SHARE = 20, 8, 3, 0.1
_ROLE = {"article": "a", "body": "b", "hint": "h"}
_NAME = {v: k for k, v in _ROLE.items()}
_words = WordHashes()
Block = tuple[str, str]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _text_blocks(html: str | None) -> tuple[Block, ...]:
    return tuple(b for b in all_blocks(html) if b[0] != "chrome")


def _tokens(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass").split(b" ")
    return _words.of(raw, len(raw))


@dataclass
class Repeats:
    """On how many different pages of a host its blocks (by hash) and its runs of tokens
    (by hash) stand, out of ``total``. What is not listed is too rare to matter."""

    total: int = 0
    blocks: dict[int, int] = field(default_factory=dict)
    runs: dict[int, int] = field(default_factory=dict)


def repeats(pages: Collection[tuple[Block, ...]], least: int = LEAST) -> Repeats:
    """What the different ``pages`` (their blocks) of one host repeat."""
    blocks: dict[int, int] = {}
    for page in pages:
        for h in {_hash(text) for _, text in page}:
            blocks[h] = blocks.get(h, 0) + 1
    found = run_counts([[w for _, text in page if len(w := _tokens(text)) >= least] for page in pages], least)
    return Repeats(len(pages), blocks, {int(h): int(n) for h, n in zip(*found) if n > 1})


def run_counts(pages: Sequence[Sequence[np.ndarray]], least: int, hot: np.ndarray | None = None, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``least`` tokens inside the pages' blocks (the hashes of their
    words), and on how many of the pages each stands; with ``hot``, only of runs that hold
    one of these anchors."""
    # A block has an end of its own, so that no run passes from one to the next; it is a
    # negative number here, which no other block shares.
    flat, n_ends = [], 0
    for page in pages:
        parts = [w for w in page if len(w) >= least]
        flat.append((parts, np.arange(n_ends, n_ends + len(parts))))
        n_ends += len(parts)
    if not n_ends:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = np.concatenate([w for parts, _ in flat for w in parts])
    ids = np.unique(every, return_inverse=True)[1].astype(np.int64)
    streams, at = [], 0
    hashes: list[np.ndarray] = []
    wanted: list[np.ndarray] = []
    for parts, ends in flat:
        stream = [np.zeros(0, np.int64)]
        for w, end in zip(parts, ends.tolist()):
            stream += [ids[at : at + len(w)], np.array([-1 - end])]
            at += len(w)
            h = np.zeros(len(w) + 1, np.uint64)
            ok = np.zeros(len(w) + 1, bool)
            h[: len(w) - least + 1] = run_hashes(w, least)
            if hot is None:
                ok[: len(w) - least + 1] = True
            else:
                held = np.concatenate([[0], np.cumsum(np.isin(run_hashes(w, anchor), hot))])
                span = least - anchor + 1
                ok[: len(w) - least + 1] = held[span:] > held[: len(held) - span]
            hashes.append(h)
            wanted.append(ok)
        streams.append(np.concatenate(stream))
        hashes.append(np.zeros(1, np.uint64))  # the page's end
        wanted.append(np.zeros(1, bool))
    order, number, n = _runs(streams, least)
    ok, h = np.concatenate(wanted)[order], np.concatenate(hashes)[order]
    first = np.flatnonzero(ok & (np.diff(number, prepend=-1) > 0))  # members of a number agree in both
    return h[first], n[number[first]]


def main_text(blocks: Sequence[Block], seen: Repeats, *, least: int = LEAST, min_pages: int = MIN_PAGES, share: float = SHARE, max_cover: float = 0.7) -> str:
    """The main text of a page, given on how many pages of its host things stand.

    A body block goes if it stands on ``share`` of the pages, or has ``least`` tokens and
    stands on ``min_pages``; of others, runs of ``least`` tokens on ``share`` of the pages
    are cut, and the block goes if they cover ``max_cover`` of it. An article block goes
    only whole, and if it, or runs that cover it so, stand on most pages; an article of
    nothing else stays. Beside an article, a stretch of body with fewer than ``least``
    tokens left is no text. Hinted blocks count as body on a page without any other text.
    """
    often, most = max(min_pages, share * seen.total), max(min_pages, seen.total // 2 + 1)

    def rest(role: str, text: str) -> str:
        need, size = most if role == "article" else often, text.count(" ") + 1
        n = seen.blocks.get(_hash(text), 0) if seen.blocks else 0
        if n >= need or role == "body" and size >= least and n >= min_pages:
            return ""
        if not seen.runs or size < least:
            return text
        frequent = [seen.runs.get(h, 0) >= need for h in run_hashes(_tokens(text), least).tolist()]
        if not any(frequent):
            return text
        own = np.zeros(size, bool)
        for i in np.flatnonzero(frequent):
            own[i : i + least] = True
        if own.sum() >= max_cover * size:
            return ""
        return text if role == "article" else " ".join(w for w, c in zip(text.split(" "), own) if not c)

    def kept(blocks: Sequence[Block]) -> list[str]:
        left = [(role, rest(role, text)) for role, text in blocks]
        has_article = any(role == "article" for role, _ in blocks)
        if has_article and not any(t for role, t in left if role == "article"):
            left = [(role, text if role == "article" else t) for (role, t), (_, text) in zip(left, blocks)]
        out: list[str] = []
        for role, stretch in groupby(left, key=lambda b: b[0]):
            texts = [t for _, t in stretch if t]
            if role == "article" or not has_article or sum(t.count(" ") + 1 for t in texts) >= least:
                out += texts
        return out

    return " ".join(kept([b for b in blocks if b[0] in ("article", "body")]) or kept([("body", text) for role, text in blocks if role == "hint"]))


def main_texts(pages: Sequence[str | None], **how: float) -> list[str]:
    """The main text of each page of a host, of which these are all pages."""
    blocks = [_text_blocks(h) for h in pages]
    seen = repeats(dict.fromkeys(blocks), int(how.get("least", LEAST)))
    return [main_text(b, seen, **how) for b in blocks]


PARSED = "page_id long, url string, host string, page long, roles string, text string, items array<long>"
_ODD = 0x9E3779B97F4A7C15


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _item(h: np.ndarray | int, salt: int) -> np.ndarray | int:
    """A hash for its host, with two low bits free: one tells anchors from blocks, one
    blocks that ``min_pages`` pages are enough for."""
    if isinstance(h, int):
        return ((h ^ salt) * _ODD & 0xFFFFFFFFFFFFFFFF) >> 2 << 2
    return (h ^ np.uint64(salt)) * np.uint64(_ODD) >> np.uint64(2) << np.uint64(2)


def _items(blocks: Sequence[Block], salt: int, least: int, anchor: int) -> list[int]:
    """What is counted of a page: its blocks and the anchors of its runs."""
    found = {_signed(_item(_hash(text), salt) | (role != "article" and text.count(" ") + 1 >= least)) for role, text in blocks}
    long = [w for _, text in blocks if text.count(" ") + 1 >= least and len(w := _tokens(text)) >= least]
    if not long:
        return list(found)
    n = np.array([len(w) for w in long])
    grams = run_hashes(np.concatenate(long), anchor)
    spans = np.lib.stride_tricks.sliding_window_view(grams, least - anchor + 1)
    left = np.repeat(np.cumsum(n), n) - np.arange(n.sum())  # tokens from here to the block's end
    start = np.flatnonzero(left[: len(spans)] >= least)
    at = np.unique(start + spans[start].argmin(1))
    anchors = np.unique(_item(grams[at], salt) | np.uint64(2)).view(np.int64)
    return [*found, *anchors.tolist()]


def _parser(least: int, anchor: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only_cache("pages", _words.clear)
        for frame in frames:
            rows = []
            for host, html in zip(frame["host"], frame["html"]):
                blocks = _text_blocks(html)
                roles, text, salt = "".join(_ROLE[r] for r, _ in blocks), "\n".join(t for _, t in blocks), _hash(host)
                rows.append((_signed(_hash(f"{roles}\n{text}") ^ salt), roles, text, _items(blocks, salt, least, anchor)))
            page, roles, texts, items = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "host": frame["host"], "page": page, "roles": roles, "text": texts, "items": items})

    return parse


def _blocks_of(roles: str, text: str) -> list[Block]:
    return list(zip((_NAME[r] for r in roles), text.split("\n"))) if roles else []


def extract(df: DataFrame, *, group: int = 256, group_tokens: int = 1_000_000, **how: float) -> DataFrame:
    """The main text of every page of ``df`` (page_id, url, html): page_id, url, text
    (empty if none) and n_chars.

    Pages are parsed where they lie; what moves is a hash per block and anchor. Pages with
    a frequent anchor, each once, are dealt into groups of about ``group`` of a host, and
    into suffix arrays of about ``group_tokens`` tokens; neither number changes a result.
    A host with fewer different pages than ``min_pages`` repeats nothing. A null page is
    empty, a very long one is one block list like any other; null and relative urls share
    a host of their own; repeated rows are separate pages with equal texts; other columns
    are not read; an empty table gives no row.
    """
    least, min_pages, share = int(how.get("least", LEAST)), int(how.get("min_pages", MIN_PAGES)), how.get("share", SHARE)
    anchor = min(ANCHOR, least)
    few = lambda x, n: F.broadcast(x) if n <= 1_000_000 else x
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    parsed, _ = table(df.select("page_id", "url", "html", host.alias("host")).mapInPandas(_parser(least, anchor), PARSED), "page-blocks")

    hosts = parsed.groupBy("host").agg(F.count_distinct("page").alias("total")).filter(F.col("total") >= min_pages)
    hosts, _ = table(hosts.withColumn("often", F.greatest(F.lit(float(min_pages)), F.col("total") * F.lit(float(share)))), "hosts")
    n_hosts = hosts.count()
    items = parsed.select("host", "page", F.explode("items").alias("x")).join(few(hosts, n_hosts), "host")
    items = items.select("page", "total", F.col("x").bitwiseAND(-2).alias("item"), F.when(F.col("x").bitwiseAND(1) == 1, F.lit(float(min_pages))).otherwise(F.col("often")).alias("need"))
    # Most items stand on one page: one exchange finds them, and only the others are counted.
    twice, twice_path = table(items.groupBy("item").agg(F.min("page").alias("a"), F.max("page").alias("z")).filter("a < z").select("item"), "twice")
    hot = items.join(few(twice, twice.count()), "item").groupBy("item").agg(F.count_distinct("page").alias("n"), F.min("need").alias("need"))
    hot, _ = table(hot.filter("n >= need").select("item", "n"), "repeats")
    discard(df.sparkSession, twice_path)
    n_hot = hot.count()
    if not n_hot:
        return _texts(parsed.withColumns({"total": F.lit(0), "found": F.lit(None).cast("array<struct<item:long,n:long>>"), "runs": F.lit(None).cast("array<struct<run:long,n:long>>")}), how)
    found = items.join(few(hot, n_hot), "item").groupBy("page").agg(F.max("total").alias("total"), F.collect_set(F.struct("item", "n")).alias("found"))
    found, _ = table(found, "page-repeats")
    n_found = found.agg(F.sum(F.size("found"))).collect()[0][0]
    some = parsed.drop("items").join(few(found, n_found), "page", "left")

    runs, _ = table(_frequent_runs(some.filter("exists(found, x -> x.item & 2 = 2)").dropDuplicates(["page"]), hosts, few(hosts, n_hosts), group, group_tokens, least, anchor), "runs")
    lists = runs.groupBy("host").agg(F.collect_list(F.struct("run", "n")).alias("runs"))  # runs on a share of the pages: a host's list is bounded
    return _texts(some.join(few(lists, runs.count()), "host", "left"), how)


def _frequent_runs(pages: DataFrame, hosts: DataFrame, few_hosts: DataFrame, group: int, group_tokens: int, least: int, anchor: int) -> DataFrame:
    """(host, run, n) of runs that stand on ``often`` of a host's pages, from its
    different pages that hold a frequent anchor."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.transform(F.filter("found", lambda x: x["item"].bitwiseAND(2) == 2), lambda x: x["item"])
    dealt = pages.select("host", "page", "roles", "text", hot.alias("hot")).join(few_hosts.select("host", F.ceil(F.col("total") / group).cast("int").alias("parts")), "host")
    dealt = dealt.select("host", F.pmod("page", "parts").cast("int").alias("part"), "text", "hot").repartition(n, "host", "part").sortWithinPartitions("host", "part")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only_cache("pages", _words.clear)
        at: tuple | None = None
        held: list[list[np.ndarray]] = []
        anchors: list[np.ndarray] = []
        size = 0

        def done() -> pd.DataFrame:
            h, c = run_counts(held, least, np.unique(np.concatenate(anchors)), anchor)
            return pd.DataFrame({"host": at[0], "run": h.view(np.int64), "n": c})

        for frame in frames:
            for host, part, text, hot in zip(*(frame[c] for c in ("host", "part", "text", "hot"))):
                if held and ((host, part) != at or size >= group_tokens):
                    yield done()
                    held, anchors, size = [], [], 0
                at = (host, part)
                salt, mine = _hash(host), np.asarray(hot, np.int64).view(np.uint64)
                long = [w for t in text.split("\n") if t.count(" ") + 1 >= least and len(w := _tokens(t)) >= least]
                grams = [(w, run_hashes(w, anchor)) for w in long]
                with_hot = [(w, g[np.isin(_item(g, salt) | np.uint64(2), mine)]) for w, g in grams]
                held.append([w for w, g in with_hot if len(g)])
                anchors += [g for _, g in with_hot if len(g)]
                anchors.append(np.zeros(0, np.uint64))
                size += sum(len(w) for w in held[-1])
        if held:
            yield done()

    sums = dealt.mapInPandas(count, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("n"))
    return sums.join(few_hosts.select("host", "often"), "host").filter("n >= often").select("host", "run", "n")


def _texts(ready: DataFrame, how: dict[str, float]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only_cache("pages", _words.clear)
        recent: OrderedDict[str, dict[int, int]] = OrderedDict()  # hosts' runs
        for frame in frames:
            texts = []
            for host, roles, text, total, items, ns, runs, run_ns in zip(*(frame[c] for c in ("host", "roles", "text", "total", "items", "ns", "runs", "run_ns"))):
                blocks, seen = _blocks_of(roles, text), Repeats()
                if items is not None:
                    salt, counts = _hash(host), dict(zip(items.tolist(), ns.tolist()))
                    own = {_hash(t) for _, t in blocks}
                    seen = Repeats(int(total), {h: n for h in own if (n := counts.get(_signed(_item(h, salt))))})
                if runs is not None:
                    if host not in recent:
                        recent[host] = dict(zip(runs.view(np.uint64).tolist(), run_ns.tolist()))
                        if len(recent) > 64:
                            recent.popitem(last=False)
                    seen.runs = recent[host]
                texts.append(main_text(blocks, seen, **how))
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    flat = ready.select("page_id", "url", "host", "roles", "text", "total", F.col("found.item").alias("items"), F.col("found.n").alias("ns"), F.col("runs.run").alias("runs"), F.col("runs.n").alias("run_ns"))
    return flat.mapInPandas(run, "page_id long, url string, text string, n_chars long")
