"""HTML extraction: page shapes by hand, and templates against a plain count."""

import random
from collections import defaultdict

import pytest

from codeloom.llm import html_text
from codeloom.llm.html_text import Page

SHAPES = {
    "article": ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header>"
                "<nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>Head &amp; more</h1><p>One\n two<br>three<p><b>Four</b> five"
                "<form>Search</form><aside>See also</aside><section class='comments'><p>First!</p></section>"
                "<article><p>A reader</p></article></article><footer>&copy; us</footer></body></html>",
                "Head & more\nOne two three\nFour five"),
    "no ends": ("<article><p>one<p>two<ul><li>a<li>b</ul>tail", "one\ntwo\na\nb\ntail"),
    "upper case": ("<BODY><ARTICLE><P>Caf&eacute; &#8212; &#x41;&nbsp;b</P></ARTICLE></BODY>", "Café — A b"),
    "comment": ("<article><p>a<!-- <p>no</p> -->b</p><!-- open <p>no", "ab"),
    "raw text": ("<article><p>a<script>if (a<b) '</p><p>'</script>b</p></article>", "ab"),
    "quotes": ("<article><p title='a > b'>one</p><p title=\"x>y>\">two</p></article>", "one\ntwo"),
    "open quote": ("<article><p title=\"x>one</p><p>two</p></article>", "one\ntwo"),
    "less than": ("<article><p>1 < 2 and 3<4</p></article>", "1 < 2 and 3<4"),
    "inline": ("<article><p>a<i>b</i>c <a href=x>d</a></p></article>", "abc d"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b\nc"),
    "main": ("<body><div class=menu>Menu</div><main><h1>T</h1><div class='ad-box'>Buy</div><p>text</p></main></body>", "T\ntext"),
    "role": ("<body><div role=navigation>Menu</div><div role='main'><p>text</p></div><div>other</div></body>", "text"),
    "no article": ("<body><div id=sidebar>Links</div><div><p>Some text that is long enough here.</p></div>"
                   "<div class=cookie-notice>We use cookies</div></body>", "Some text that is long enough here."),
    "form around the page": ("<body><form><p>The whole text stands inside of a form.</p></form></body>",
                             "The whole text stands inside of a form."),
    "nav around the article": ("<nav><a>x</a><article><p>text</p></article>", "text"),
    "hidden": ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    "article header": ("<article><header><h1>Title</h1></header><p>x</p><footer>By us</footer></article>", "Title\nx"),
    "empty": ("", ""), "text": ("just text", "just text"), "only a menu": ("<nav>Menu</nav>", ""),
    "deep": ("<article>" + "<div><span>" * 3000 + "x" + "</span></div>" * 3000 + "</article>", "x"),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    source, text = SHAPES[name]
    assert Page(source).text(set()) == text


def site(rnd, host, n):
    """Pages without any telling name: a template around paragraphs, some of which many pages quote."""
    words = lambda k: " ".join("".join(rnd.choices("abcdefg", k=5)) for _ in range(k))
    menu, legal, quote = words(6), words(9), words(12)
    out = []
    for i in range(n):
        body = [words(30), quote if i % 2 else words(12), words(20)]
        inner = "".join(f"<p>{p}</p>" for p in body)
        out.append((f"http://{host}/{i}", f"<body><div><ul><li>{menu}</ul></div><div>{inner}</div><div><i>{legal}</i><div>{words(1)}</div></div>"
                    f"<div><b>Seen</b><div>{legal}</div></div></body>", menu, legal, body))
    return out


def test_templates_go_by_count(spark):
    rnd = random.Random(2)
    pages = site(rnd, "big.example.com", 12) + site(rnd, "small.example.com", 3)
    copies = [(f"http://copy.example.com/{i}", *pages[0][1:]) for i in range(20)]  # copies are no template
    rows = [(i, u, h) for i, (u, h, *_) in enumerate(pages + copies)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (url, _, menu, legal, body) in enumerate(pages + copies):
        lines = got[i].split("\n")
        assert [x for x in lines if x in body] == body  # paragraphs stay, quoted ones too
        assert (menu in lines) == ("big" not in url)
        assert lines.count(legal) == (1 if "big" in url else 2)  # one of them stands in a subtree that differs


def test_template_inside_the_article(spark):
    rows = [(i, "http://a.example.com/x", f"<article><p>Own text {i}</p><p>We all quote this.</p><div class=x><p>Vote for us</p></div></article>")
            for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own text {i}\nWe all quote this." for i in range(6)}


def test_subtree_counts_equal_brute_force(spark):
    rnd = random.Random(8)
    pages = [(h, s) for n in (4, 5, 9) for h, s, *_ in site(rnd, f"h{n}.example.com", n)]
    pages += pages[:7]
    seen = defaultdict(set)
    for url, source in pages:
        page = Page(source)
        for sub in page.subtrees().values():
            seen[html_text.host(url), sub].add(page.main_text())
    want = [(u, Page(s).text({sub for (h, sub), m in seen.items() if h == html_text.host(u) and len(m) >= 5})) for u, s in pages]
    got = html_text.extract(spark.createDataFrame(pages, "url string, html string").repartition(3))
    assert got.columns == ["url", "text"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_html_edges(spark):
    rows = [(None, None, None, 1, "x"), (1, "", "", 2, "x"), (1, "no host", "<p>a</p>", 3, "x"), (1, "no host", "<p>a</p>", 3, "x"),
            (2, "http://H.example.com", "<p>" + "long " * 100_000, 4, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, one int, text string")
    for extra in ("two", "gone", "host", "sub", "main", "subs"):
        pages = pages.selectExpr("*", f"7 AS {extra}")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "one", "two", "gone", "host", "sub", "main", "subs", "text"]
    assert sorted(((r.page_id, r.one, r.text[:9]) for r in got.collect()), key=repr) == [
        (1, 2, ""), (1, 3, "a"), (1, 3, "a"), (2, 4, "long long"), (None, 1, "")]
    assert html_text.extract(pages.filter("false")).count() == 0
    assert html_text.host("HTTP://AbÇ.Example.com?x") == "abÇ.example.com"
