import html
import re

from runeflow.llm import html_text as h
from runeflow.llm import queries


def brute(page):
    """The tables' own pages: the article element's text, tags that end blocks made spaces, others dropped."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    text = re.sub(r"</?(?:p|h1|br)>", " ", body[1]) if body else ""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", text)).split())


def test_whole_table(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.page_id: r for r in queries.op1_html(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        assert rows[p.page_id].text == brute(p.html), p.page_id
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_repeats_and_optionals_are_inferred():
    a = h.fold(["ul", "li", "#", "/li", "li", "#", "/li", "/ul", "p", "#", "/p"])
    b = h.fold(["ul", "li", "#", "/li", "/ul", "div", "#", "/div", "p", "#", "/p", "p", "#", "/p"])
    w = h.align(a, b)
    assert ("+", "li", "#", "/li") in w and ("+", "p", "#", "/p") in w
    assert ("?", "div") in w and ("?", "#") in w
    assert h.align(w, a) == w and h.align(w, b) == w
    assert h._load(h._dump(w)) == w


PAGE = """<html><head><title>t</title><script>var a="<p>x</p>";</script></head><body>
<header><h1>Site</h1></header><div id="menu-3"><a href=x>Home</a></div><div class='cookie-notice'>We use</div>
<main><h2>A &lt;title&gt;</h2><p>One <b>bo</b>ld&nbsp;word.<p>Two<br>lines<ul><li>i</li><li>j</ul>
<form><input>send</form><aside>side</aside><div class="comments"><p>reader</p></div><p style="display:none">hid</p></main>
<footer>foot</footer><!-- <p>c</p> --></body></html>"""


def test_what_is_kept(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", PAGE, 9), (2, "http://a.b/d", None, 9), (3, None, "", 9), (4, "http://q/", "<div><p>only this</p></div> &amp; that < or", 9), (4, "http://q/", "<p>open <b>bold <p>next", 9)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text) for r in h.extract_text(df).collect())
    assert got == [(1, "A <title> One bold word. Two lines i j"), (2, ""), (3, ""), (4, "only this & that < or"), (4, "open bold next")]
    assert h.extract_text(df.limit(0)).count() == 0


def test_odd_markup_ends():
    for page in ("<", "<p", "<p class=\"x", "<a href='" + "y" * 100_000, "<!--", "</p></b>", "<script>", "<p " + "\"'" * 5000, "&#0;&#x110000;&bogus;", "<p>" * 3000):
        h.parse(page)


def texts_of(spark, pages):
    df = spark.createDataFrame([(k, u, t) for k, (u, t) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in h.extract_text(df).collect()}


def test_fixed_slots_inside_articles_are_left_out(spark):
    """Boilerplate under neutral names, a slot of its own or one of the repeated paragraphs, on every page of a host."""
    page = "<article><h1>T{0}</h1><div class=x>By our desk</div>{1}<p>Write to us</p></article>"
    pages = [("http://a.b/", page.format(k, "".join(f"<p>s{k}-{j}</p>" for j in range(1 + k % 3)))) for k in range(12)]
    got = texts_of(spark, pages)
    assert got == {k: " ".join([f"T{k}", *[f"s{k}-{j}" for j in range(1 + k % 3)]]) for k in range(12)}
    assert texts_of(spark, [("http://a.b/", page.format(0, "<p>s</p>"))] * 8)[3] == "T0 By our desk s Write to us"


def test_blocks_stand_in_the_wrappers_slots():
    streams = [h.parse(t)[0] for t in ("<h1>a</h1><p>b<p>c<div>d</div>", "<h1>a</h1><p>b<div>d</div>", "<h1>a</h1><div>d</div>")]
    w = h.fold(streams[0])
    for x in streams[1:]:
        w = h.fold(h.align(w, h.fold(x)))
    assert [h.Wrapper(w).places(x) for x in streams] == [[0, 1, 1, 2], [0, 1, 2], [0, 2]]


def test_varied_paragraphs_stay_however_many(spark):
    """More than 640 blocks of one place in a batch, on a host without article elements."""
    pages = [("http://hot/", f"<div><h2>t{k}</h2>" + "".join(f"<p>p{k}-{j}</p>" for j in range(5)) + "<p>the same</p></div>") for k in range(200)]
    assert texts_of(spark, pages) == {k: " ".join([f"t{k}", *[f"p{k}-{j}" for j in range(5)]]) for k in range(200)}


def test_each_page_decides_by_its_own_elements(spark):
    """Two templates on one host, and pages without a url: those without an article keep their text."""
    for url in ("http://two/", None):
        pages = [(url, "<article><p>one</p></article><div>aside of it</div>"), (url, "<div><p>two</p></div>"), (url, "<article></article><p>not the article's</p>"), (url, "<aside><article><p>a card</p></article></aside><p>three</p>")]
        assert texts_of(spark, pages) == {0: "one", 1: "two", 2: "", 3: "three"}


def test_the_wrapper_decides(spark, monkeypatch):
    """With empty wrappers fixed slots aren't known any more, so boilerplate under neutral names stays."""
    page = "<article><h1>T{0}</h1><div class=x>By our desk</div>{1}<div class=y><i>{0}</i></div></article>"
    pages = [("http://a.b/", page.format(k, f"<p>s{k}</p><div class=x>Read {k} more</div>")) for k in range(12)]
    got = texts_of(spark, pages)
    assert got[3] == "T3 s3 Read 3 more 3"
    monkeypatch.setattr(h, "align", lambda a, b: [])
    monkeypatch.setattr(h.Wrapper, "places", lambda self, stream: [-1] * stream.count(h.SLOT))
    reader = h.Reader()
    slots = {s for s, *_ in reader.read(pages[0][1], "[]")}
    assert all(":" in s for s in slots)  # by path alone, where the two blocks of one name are one


def test_hosts_of_many_shapes_are_aligned_in_rounds(spark, monkeypatch):
    """Distinct shapes beyond a task's share; alignment in rounds gives the texts that one round gives."""
    page = "<article><h1>T{0}</h1><div>By our desk</div>{1}</article>"
    tags = ("p", "h2", "ul", "blockquote", "h3", "pre")
    pages = [("http://many/", page.format(k, "".join(f"<{tags[(k // 6**j) % 6]}>s{k}-{j}</{tags[(k // 6**j) % 6]}>" for j in range(3)))) for k in range(216)]
    want = {k: " ".join([f"T{k}", *[f"s{k}-{j}" for j in range(3)]]) for k in range(216)}
    assert texts_of(spark, pages) == want
    monkeypatch.setattr(h, "TOGETHER", 5)
    assert texts_of(spark, pages) == want


def test_very_long_pages_and_clashing_names(spark):
    body = "".join(f"<p>word{k} and more</p>" for k in range(8_000))
    df = spark.createDataFrame([(1, "http://l/", f"<main>{body}</main>", "x", 5, "y")], "page_id long, url string, html string, wrapper string, n_chars int, host string")
    (row,) = h.extract_text(df).collect()
    assert row.text == " ".join(f"word{k} and more" for k in range(8_000)) and row.n_chars == len(row.text)
