import numpy as np
import pytest

from chiweave.llm import html_extraction as H
from chiweave.llm.language_id import language_id

PAGE = """<!DOCTYPE html><html lang="en"><head><title>t</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a>Home</a><li><a>More</a></ul></nav><!-- note --><div class="cookie-notice">We use cookies</div>
<article><header><h1>Big &amp; bold</h1></header><p>First <b>para</b>graph&nbsp;here<br>goes   on.<p>Second &#233;&euro; one
<aside>Related links</aside><form>Your mail <input></form><table><tr><td>cell</td><td>next</td></tr></table>
<section id="comments"><p>I disagree</p></section><div hidden>secret</div></article>
<footer>&copy; all</footer></body></html>"""


def text(html):
    return H.main_texts([html])[0]


def test_article_without_its_surroundings():
    assert text(PAGE) == "Big & bold First paragraph here goes on. Second é€ one cell next"


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<html>", "</p></div>", "<article>", "<p><b><i>", "<!--", "<script>x"])
def test_broken_pages_do_not_crash(html):
    assert isinstance(text(html), str)


def test_unclosed_and_stray_tags():
    assert text("<article><p>a<div>b</span></div>c</article>d") == "a b c"


def test_an_articles_own_header_stays():
    assert text('<div class="header">Site</div><article><div class="post-header"><h1>Title</h1></div><p>Body</p></article>') == "Title Body"


def test_suffix_array_and_prefixes_equal_brute_force():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 200):
        x = rng.integers(0, 3, n)
        order = H.suffix_array(x)
        assert order.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
        lcp = H.common_prefixes(x, order)
        for k in range(1, n):
            a, b = x[order[k - 1] :], x[order[k] :]
            m = min(len(a), len(b))
            eq = np.flatnonzero(a[:m] != b[:m])
            assert lcp[k] == (eq[0] if len(eq) else m)


def test_covered_tokens_equal_brute_force():
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, n).tolist() for n in (30, 25, 0, 40, 10)]
    got = H.covered_tokens(pages, 3, 3)
    grams = {}
    for i, p in enumerate(pages):
        for j in range(len(p) - 2):
            grams.setdefault(tuple(p[j : j + 3]), set()).add(i)
    for p, c in zip(pages, got):
        want = [False] * len(p)
        for j in range(len(p) - 2):
            if len(grams[tuple(p[j : j + 3])]) >= 3:
                want[j : j + 3] = [True] * 3
        assert c.tolist() == want


def test_repeated_runs_go_and_unique_ones_stay():
    pages = [f"<body><div>sign up for our daily letter now</div><p>story {i} tells of thing {i * 7}</p><div>all rights are reserved by us here</div></body>" for i in range(6)]
    assert H.main_texts(pages) == [f"story {i} tells of thing {i * 7}" for i in range(6)]


def test_articles_that_copy_each_other_stay_whole():
    pages = ["<article><p>one and the same long story told again</p></article>"] * 5
    assert H.main_texts(pages) == ["one and the same long story told again"] * 5


def pages(spark):
    rows = [(i, f"https://h{i % 2}.example.com/en/{i}", PAGE) for i in range(5)]
    rows += [(5, None, PAGE), (6, "https://x.de/a", None), (None, "no address", "<p>text</p>"), (7, "https://h0.example.com/en/7", PAGE), (7, "https://h0.example.com/en/7", PAGE)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS host", "1 AS part")


def test_extract_over_hosts(spark):
    got = H.extract(pages(spark)).collect()
    assert len(got) == 10
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[5]["text"] == text(PAGE) and by[1]["n_chars"] == len(text(PAGE))
    assert by[6]["text"] == "" and by[6]["n_chars"] == 0 and by[None]["text"] == "text"
    assert H.extract(pages(spark).limit(0)).count() == 0
    assert {r["text"] for r in H.extract(pages(spark), group=2).filter("page_id < 5").collect()} == {text(PAGE)}


def test_language_evidence(spark):
    en, de = "the cat and the dog are in the house with that man ", "der hund und die katze sind nicht mit dem mann in das haus "
    docs = spark.createDataFrame([(en * 20, "en"), (de * 20, "de"), (None, "en"), ("x", None)], "text string, lang string")
    page = lambda lang, body: f'<html lang="{lang}"><body><article><p>{body}</p></article></body></html>'
    rows = [(i, f"https://a.example.org/en/{i}", page("en", en * 3)) for i in range(20)] + [(20 + i, f"https://b.example.de/de/{i}", page("de", de * 3)) for i in range(20)]
    rows += [(50, "https://a.example.org/en/x", page("en", de * 3)), (51, "https://b.example.de/de/y", page("de", "")), (52, None, None), (None, "https://c.example.de/", "<p>" + de)]
    got = {r["page_id"]: r for r in language_id(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert all(got[i]["lang"] == "en" for i in range(20)) and all(got[20 + i]["lang"] == "de" for i in range(20))
    assert got[50]["lang"] == "de"  # the text outweighs a wrong declaration
    assert got[51]["lang"] == "de" and got[51]["declared"] == "de"  # and without text the rest decides
    assert got[52]["lang"] in ("de", "en") and got[None]["lang"] == "de"
    assert all(0 < r["probability"] <= 1 for r in got.values())
    empty = language_id(spark.createDataFrame(rows, "page_id long, url string, html string"), docs.limit(0)).collect()
    assert {r["lang"] for r in empty} == {None} and len(empty) == len(rows)
