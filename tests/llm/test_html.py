"""Main text of pages: furniture and templates go, blocks stay in order; awkward rows."""

import pytest

from quern.llm import html_extraction


def page(k, body):
    menu = '<ul class="x1"><li><a href="/">Home</a></li><li>All</li></ul>'
    foot = '<div class="x2"><p>Made by us</p><p>Terms</p></div>'
    return f"<html><head><title>t{k}</title><style>p {{}}</style></head><body>{menu}<div class='c'>{body}</div>{foot}</body></html>"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, f"https://h.example.com/{k}", page(k, f"<h1>Title {k}</h1><p>First &amp; {k}\n  text</p><p>Second<br>{k}</p>")) for k in range(12)]
    rows += [
        (100, "https://other.example.com/1", "<article><p>Text one</p><nav>menu</nav><div class='comments'><p>first!</p></div><p>Text &lt;two&gt;</p></article><p>outside</p>"),
        (101, None, None),
        (102, "https://other.example.com/2", ""),
        (103, "https://other.example.com/3", "no markup at all"),
        (104, "https://other.example.com/4", "<p>unclosed <b>bold<p>next<script>var x = '<p>no</p>';</script><ul><li>one<li>two</ul>"),
        (105, "https://other.example.com/5", "<main>" + "<p>long text</p>" * 20000 + "</main>"),
        (105, "https://other.example.com/5", "<main><p>same id</p></main>"),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    found = html_extraction.extract(table).collect()
    assert len(found) == len(rows)
    return found


def text(texts, k):
    return [r.text for r in texts if r.page_id == k]


def test_template_goes(texts):
    for k in range(12):
        assert text(texts, k) == [f"Title {k}\nFirst & {k} text\nSecond {k}"]


def test_furniture_and_article(texts):
    assert text(texts, 100) == ["Text one\nText <two>"]


def test_awkward_pages(texts):
    assert text(texts, 101) == [""] and text(texts, 102) == [""]
    assert text(texts, 103) == ["no markup at all"]
    assert text(texts, 104) == ["unclosed bold\nnext\none\ntwo"]
    assert sorted(map(len, text(texts, 105))) == [7, 20000 * 10 - 1]
    assert all(r.n_chars == len(r.text) for r in texts)


def test_small_host_has_no_template(spark):
    rows = [(k, "https://s.example.com/", "<div><p>always the same</p></div>") for k in range(50)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"always the same"}


def test_empty_table(spark):
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html_extraction.extract(pages).collect()
    assert len(got) == pages.count()
    assert sum(bool(r.text) for r in got) > 0.9 * len(got)
    assert not any("\n\n" in r.text or r.text != r.text.strip() or "  " in r.text for r in got)


@pytest.mark.parametrize(
    "body,want",
    [
        ("<div class='layout has-sidebar'><article><p>one</p></article></div>", "one"),
        ("<div id='page' class='no-header'><p>one</p><p>two</p></div>", "one\ntwo"),
        ("<article><div class='article-header'><h1>head</h1></div><p>one</p></article>", "head\none"),
        ("<article><div class='teaser'>lead</div><p>one</p></article>", "lead\none"),
        ("<article><p>one</p><table class='comments-by-year'><tr><td>a</td><td>b</td></tr></table></article>", "one\na\nb"),
    ],
)
def test_classes_alone_dont_empty_a_page(spark, body, want):
    got = html_extraction.extract(spark.createDataFrame([(1, "https://a.example.com/", body)], "page_id long, url string, html string")).first()
    assert got.text == want


def _subtrees(html):
    """Bytes and place of each block element of a well-formed page, but for its frame."""
    import re

    out, stack = [], []
    for m in re.finditer(r"<(/?)([a-z0-9]+)[^>]*>", html):
        if not m[1]:
            stack.append((m[2], m.start()))
        else:
            name, at = stack.pop()
            assert name == m[2]
            if name in ("div", "p", "ul", "li"):
                out.append((tuple(n for n, _ in stack), name, html[at : m.end()]))
    return out


def test_templates_are_the_recurring_subtrees(spark):
    """The number of template subtrees of a host, against a count of all blocks' bytes and places over different pages."""
    import random
    from collections import Counter

    rng = random.Random(5)
    part = lambda k: f"<div><p>part {k}</p><ul><li>x{k % 3}</li></ul></div>"
    pages = ["<html><body>" + "".join(part(rng.randrange(12)) for _ in range(rng.randrange(1, 5))) + f"<p>own {k}</p></body></html>" for k in range(40)]
    pages += pages[:5]  # copies count once
    seen = Counter(t for p in set(pages) for t in set(_subtrees(p)))
    table = spark.createDataFrame([(k, "https://h.example.com/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    found = html_extraction.templates(html_extraction.subtrees(table)).collect()
    n = len(set(pages))
    prose = ("p", "li")  # the page has no article: all of it is the main part
    want = sum(k >= html_extraction.MIN_PAGES and k >= html_extraction.SHARE * n and (t[1] not in prose or k >= html_extraction.PROSE_PAGES and k >= html_extraction.PROSE_SHARE * n) for t, k in seen.items())
    assert len(found) == len({r.tree for r in found}) == want > 0


def extracted(spark, *pages):
    """Texts of pages, each given as one page or a list of pages of a host of their own."""
    rows = [(100 * h + k, f"https://h{h}.example.com/{k}", p) for h, ps in enumerate(pages) for k, p in enumerate([ps] if isinstance(ps, str) else ps)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[100 * h] if isinstance(ps, str) else [got[100 * h + k] for k in range(len(ps))] for h, ps in enumerate(pages)]


def test_words_inside_a_kept_block_stay(spark):
    host = [f"<body><h2>Introduction</h2><p>Run <code>git</code> number {k} and <b>never</b> stop.</p><p>See also.</p></body>" for k in range(5)]
    (got,) = extracted(spark, host)
    assert got == [f"Introduction\nRun git number {k} and never stop.\nSee also." for k in range(5)]


def test_a_common_phrase_of_a_large_host_stays(spark):
    host = [f"<article><h1>T{k}</h1><p>own text {k}</p>{'<p>See also.</p>' if k % 4 == 0 else ''}<h2>Notes</h2><p>more {k}</p></article>" for k in range(60)]
    (got,) = extracted(spark, host)
    assert got == [f"T{k}\nown text {k}" + ("\nSee also." if k % 4 == 0 else "") + f"\nNotes\nmore {k}" for k in range(60)]


def test_a_notice_in_every_article_goes(spark):
    host = [f"<article><h1>T{k}</h1><p class='x'>Subscribe to our newsletter today!</p><p>own text {k}</p></article>" for k in range(12)]
    (got,) = extracted(spark, host)
    assert got == [f"T{k}\nown text {k}" for k in range(12)]


@pytest.mark.parametrize(
    "body,want",
    [
        ("<form id=aspnetForm><div><article><p>text</p></article></div></form>", "text"),
        ("<form id=f><p>all of the text is in a form here</p></form><p>x</p>", "all of the text is in a form here\nx"),
        ("<p>text that is longer</p><form><label>Name</label><input></form>", "text that is longer"),
        ("<article><p title='a hidden gem'>one</p><p class='md hidden lg'>two</p><p hidden>no</p><p aria-hidden=true>no</p><p style='Display: none'>no</p></article>", "one\ntwo"),
        ("<article><p>a longer text about it</p><section class='related'><h2>Related work</h2></section></article>", "a longer text about it\nRelated work"),
        ("<article><p>a longer text about all of it</p><div class='post-comments'>no</div><ul class='comment-list'><li>no</ul><div class=cookie-banner>no</div><div class='social-share'>no</div></article>", "a longer text about all of it"),
        ("<article><p>a longer text about it</p></article><article class='comment'><p>first!</p></article>", "a longer text about it"),
        ("<p>a longer text about it</p><div role='Search'>find</div>", "a longer text about it"),
    ],
)
def test_what_tells_content(spark, body, want):
    assert extracted(spark, f"<html><body>{body}</body></html>") == [want]


def test_templates_alone_find_the_text(spark, sf_dir):
    """Without article, nav and footer tags and without classes only the recurrence of subtrees is left to tell the text."""
    import re

    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/pages.parquet").select("page_id", "url", "html").collect()
    bare = [(r.page_id, "https://one.example.com/", re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", (r.html or "").replace(' class="ad"', ""))) for r in pages]
    table = spark.createDataFrame(bare, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(pages)).collect()}
    with_, without = ({r.page_id: r.text for r in html_extraction.extract(table, n).collect()} for n in (html_extraction.MIN_PAGES, 10**9))
    menus = sum(len(without[k].split()) - len(with_[k].split()) for k in whole)
    changed = sum(with_[k] != without[k] for k in whole)
    print(f"changed {changed} of {len(whole)}, words cut {menus}")
    assert changed > 0.9 * len(whole)


def test_no_quadratic_pages(spark):
    """Tags and quotes that never end, deep nesting and stray end tags take time in proportion to their length."""
    import time

    bad = ["<a " * 200_000, "<a '" * 200_000 + ">", "<div>" * 100_000, "<i>" * 100_000 + "<hr>" * 100_000, "<b>" * 100_000 + "</u>" * 100_000, "<!--" * 200_000, "<script>" * 100_000]
    began = time.time()
    got = html_extraction.extract(spark.createDataFrame([(k, f"https://h{k}.example.com/", b) for k, b in enumerate(bad)], "page_id long, url string, html string")).collect()
    assert len(got) == len(bad) and time.time() - began < 60
