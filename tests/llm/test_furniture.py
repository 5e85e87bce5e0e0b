import random

from helpers import prose

from chiweave.llm import html_extraction as H


def page(i, inside):
    return f"<article><h1>title {i}</h1><p>{prose(i)}</p>{inside}</article>"


def test_a_story_beside_article_teasers_stays():
    pages = [f"<div><p>{prose(i)}</p><p>short {i}</p></div><article>teaser {i}</article>" for i in range(6)]
    assert H.main_texts(pages) == [f"{prose(i)} short {i} teaser {i}" for i in range(6)]


def test_what_most_pages_repeat_inside_an_article_goes():
    pages = [page(i, "<p>read our terms</p>") for i in range(6)]
    assert H.main_texts(pages) == [f"title {i} {prose(i)}" for i in range(6)]


def test_short_runs_stay_in_unique_blocks_and_long_ones_go():
    notice = prose(999, 30)
    pages = [f"<p>{prose(i)} at the end of {prose(100 + i)} {notice} {i}</p>" for i in range(6)]
    assert H.main_texts(pages) == [f"{prose(i)} at the end of {prose(100 + i)} {i}" for i in range(6)]


def test_groups_of_a_host_count_together(spark):
    notice = prose(999, 30)
    rows = [(i, f"https://h.example.com/{i}", f"<p>{prose(i)}</p>" + (f"<div>{notice}</div>" if i % 20 == 0 else "")) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: prose(i) for i in range(80)}
    for group in (8, 256):
        assert {r["page_id"]: r["text"] for r in H.extract(df, group=group).collect()} == want


def brute_force(pages, least=20, min_pages=3, share=0.1, max_cover=0.7):
    """The operator's rules over the pages of one host, by sets of token tuples."""
    parsed = [[b for b in H.all_blocks(p) if b[0] != "chrome"] for p in pages]
    different = {tuple(b) for b in parsed}
    often, most = max(min_pages, share * len(different)), max(min_pages, len(different) // 2 + 1)

    def pages_with(run):
        return sum(any(tuple(w[i : i + len(run)]) == run for _, t in page for w in [t.split()] for i in range(len(w) - len(run) + 1)) for page in different)

    def left(role, text):
        w, need = text.split(), most if role == "article" else often
        n = sum(any(t == text for _, t in page) for page in different)
        if n >= need or role == "body" and len(w) >= least and n >= min_pages:
            return ""
        cut = set()
        for i in range(len(w) - least + 1):
            if pages_with(tuple(w[i : i + least])) >= need:
                cut |= set(range(i, i + least))
        if cut and len(cut) >= max_cover * len(w):
            return ""
        return text if role == "article" else " ".join(x for i, x in enumerate(w) if i not in cut)

    out = []
    for page in parsed:
        article = any(role == "article" for role, _ in page)
        rest = [(role, left(role, t)) for role, t in page]
        if article and not any(t for role, t in rest if role == "article"):
            rest = [(role, whole if role == "article" else t) for (role, t), (_, whole) in zip(rest, page)]
        kept, at = [], 0
        while at < len(rest):
            end = at
            while end < len(rest) and rest[end][0] == rest[at][0]:
                end += 1
            texts = [t for _, t in rest[at:end] if t]
            if rest[at][0] == "article" or not article or len(" ".join(texts).split()) >= least:
                kept += texts
            at = end
        out.append(" ".join(kept))
    return out


def furnished(seed, n):
    """Pages of a host that share notices, whole blocks and runs inside blocks, with and
    without an article, some of them copies."""
    rng = random.Random(seed)
    notices = [prose(900 + k, rng.choice((8, 21, 25, 40))) for k in range(4)]

    def block(i, k):
        own = prose(1000 * seed + 10 * i + k, rng.choice((5, 18, 30)))
        if rng.random() < 0.5:
            return own
        notice = rng.choice(notices)
        return rng.choice((notice, f"{own} {notice} {i}", f"{notice} {own}", f"{i} {notice[: len(notice) // 2]} {own}"))

    pages = []
    for i in range(n):
        body = [f"<{rng.choice(('p', 'div'))}>{block(i, k)}</p></div>" for k in range(rng.randrange(1, 5))]
        if rng.random() < 0.3:
            body.insert(rng.randrange(len(body) + 1), f"<article><p>{block(i, 8)}</p><p>{block(i, 9)}</p></article>")
        pages.append(rng.choice(pages) if pages and rng.random() < 0.1 else "".join(body))
    return pages


def test_extract_equals_brute_force_however_pages_are_grouped(spark):
    for seed, how in ((1, {}), (2, {"share": 0.3}), (3, {"least": 6, "share": 0.0})):
        pages = furnished(seed, 40)
        want = brute_force(pages, **how)
        assert H.main_texts(pages, **how) == want
        df = spark.createDataFrame([(i, f"https://h.example.com/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
        for group, tokens in ((3, 10_000), (1000, 60)):
            got = {r["page_id"]: r["text"] for r in H.extract(df, group=group, group_tokens=tokens, **how).collect()}
            assert [got[i] for i in range(len(pages))] == want


def test_a_run_on_three_pages_of_a_large_host_is_found(spark):
    notice = prose(5000, 30)
    rows = [(i, f"https://h.example.com/{i}", f"<p>{prose(i, 30)}" + (f" {notice} {i}" if i in (5, 777, 1999) else "") + "</p>") for i in range(2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df, share=0.0).collect()}
    assert got == {i: prose(i, 30) + (f" {i}" if i in (5, 777, 1999) else "") for i in range(2000)}


def test_equal_pages_without_an_article_keep_their_text():
    assert H.main_texts([f"<p>{prose(1)}</p>"] * 3) == [prose(1)] * 3


def test_names_that_only_hold_a_hint_lose_no_text():
    inside = '<article><section class="media-widget"><p>one</p></section><p class="search">two</p><div class="share-price">three</div><div class="social-share">x</div></article>'
    assert H.main_texts([inside]) == ["one two three"]
    assert H.main_texts(['<body class="share-price"><div class="share-price"><p>all of it</p></div><div id="cookieNotice">no</div></body>']) == ["all of it"]
    assert H.main_texts(['<div class="search"><p>the only text there is</p></div>']) == ["the only text there is"]


def test_a_very_long_page():
    long = " ".join(f"z{i % 977}x{i % 31}" for i in range(200_000))
    assert H.main_texts([f"<article><p>{long}</p></article>", "<p>a</p>"]) == [long, "a"]
