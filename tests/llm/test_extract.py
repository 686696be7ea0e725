from __future__ import annotations

from stratafold.llm import extract
from stratafold.llm.extract import Page

PAGE = """<html><head><title>T</title><style>x</style></head><body class="home"><header><h1>Site</h1></header><div id=cookie-notice>We use cookies</div><div class="menu"><a href=#>A</a></div>
<div class="wrap c12"><main><div class="post-7 entry"><header><h1>Title &amp; more</h1></header><p>First&nbsp;para <b>bold<p>Second <a href="x">link</a> para.<form><input>Send</form><ul><li>one<li>two</ul><blockquote>Q</blockquote><script>var a="</p>";</script><!-- c --><table><tr><td>cell</td></tr></table></div>
<section class="comments"><p>Nice post! long comment text here that is long long long</p></section></main><aside>side</aside></div><footer>foot</footer></body></html> tail"""


def own(source: str) -> str:
    page = Page(source)
    return page.text(page.best()[0]) or ""


def test_a_page():
    assert own(PAGE) == "Title & more\nFirst para bold\nSecond link para.\none\ntwo\nQ\ncell"


def test_odd_pages():
    cases = {"": "", "plain  text": "plain text", "<p>a<p>b": "a\nb", "<div><div class='x'": "", '<a href="x>y</a> z': "y z", "a &lt;b&gt; &#x41;&#10;c": "a <b> A c", "<!-- open": "", "<script>alert(1)": "", "<p>x</div></p></b>y": "x\ny", "<nav>n</nav>t": "t", "<p hidden>h</p>v": "v"}
    assert {k: own(k) for k in cases} == cases


def test_the_hosts_path_wins(spark):
    body = "<p>" + "words of the article here " * 20 + "</p>"
    usual = f"<body><div class='box1'>{body}</div><div class='links'><p>short</p></div></body>"
    # On this page another container is larger; its host's other pages say where the article is.
    odd = f"<body><div class='box2'><p>The article.</p></div><div class='extra'>{body * 3}</div></body>"
    rows = [(i, f"http://www.h.org/{i}", usual, "x") for i in range(5)] + [(9, "https://h.org/9?x", odd, "x"), (10, "http://other.org/", odd, "x"), (11, None, "<p>a</p>", "x"), (None, "::", None, "x"), (12, "http://h.org/", "<main><p>no box</p></main>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, main_text string")
    got = {r.page_id: r.main_text for r in extract.extract(pages).collect()}
    assert got[9] == "The article." and got[10].startswith("words of") and got[0].startswith("words of") and got[11] == "a" and got[None] == "" and got[12] == "no box"
    extract.BROADCAST_BYTES, before = 0, extract.BROADCAST_BYTES
    try:
        assert {r.page_id: r.main_text for r in extract.extract(pages).collect()} == got
    finally:
        extract.BROADCAST_BYTES = before


def test_names_of_other_columns_may_be_ours(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<p>a</p>", "x", "y", "z")], "page_id bigint, url string, html string, _host string, _path string, _in0 string")
    (r,) = extract.extract(pages).collect()
    assert r.asDict() == {"page_id": 1, "url": "http://h/", "_host": "x", "_path": "y", "_in0": "z", "main_text": "a"}


def test_parts_of_an_article_stay():
    body = "<p>" + "Some sentences of the article stand here. " * 5 + "</p>"
    stay = {
        "We prove <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.": "We prove x=2 holds.",
        "<svg><title>t</title><text>label one</text></svg> shown.": "label one shown.",
        "<object data=x><p>Read the table instead.</p></object>": "Read the table instead.",
        '<div class="search-results"><p>Ten searches were made, and two of them found what was lost.</p></div>': "Ten searches were made, and two of them found what was lost.",
        '<section id="related-work"><p>Others have measured the same rivers before.</p></section>': "Others have measured the same rivers before.",
        '<p data-class="menu" data-id="ad">Kept.</p>': "Kept.",
    }
    go = ['<div class="share"><a href=a>Mail</a> <a href=b>Print</a></div>', '<ul class="tags"><li>rivers<li>floods</ul>', '<div class="related"><a href=x>Another article that you might like to read, surely.</a></div>', '<div class="ad">Buy.</div>', '<div class="cookie-notice">We use cookies.</div>']
    for inner, want in stay.items():
        assert own(f"<article>{body}{inner}{body}</article>").split("\n")[1] == want, inner
    for inner in go:
        assert own(f"<article>{body}{inner}{body}</article>").count("\n") == 1, inner
    assert "found" not in own(f'<main>{body}</main><div class="search-results"><p>They found it.</p></div>')


def test_deep_pages_take_time_and_memory_in_proportion():
    import time
    import tracemalloc

    def cost(n: int) -> tuple[float, int]:
        tracemalloc.start()
        began = time.perf_counter()
        page = Page("<div><p>x" * n + "<li>y" * n + "<a>z" * n)
        text = page.text(page.best()[0])
        spent, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert text
        return spent, peak

    (a, b), (c, d) = cost(2000), cost(16000)
    assert c < 24 * max(a, 0.05) and d < 16 * b


def test_made_pages_give_the_text_they_were_made_of(spark):
    """Pages whose article is known, as it was put in block by block, among parts that are none of it."""
    import random

    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 9)))
    said = lambda n: " ".join(word() for _ in range(n)) + rng.choice([".", "!", ""])
    rows, want = [], {}
    for i in range(80):
        blocks, inside = [], []
        for _ in range(rng.randint(1, 12)):
            t = said(rng.randint(3, 60))
            escaped = t.replace("é", rng.choice(["&eacute;", "&#233;", "&#xE9;", "é"]))
            first, _, rest = escaped.partition(" ")
            inside.append(rng.choice([f"<p>{escaped}</p>", f"<p>\n  {escaped}", f"<h2>{escaped}</h2>", f"<div><p>{first}\t <b>{rest}</b></p></div>", f"<blockquote>{escaped}</blockquote>", f"<p><a href=/x>{first}</a> {rest}<!-- {word()} --><script>{word()}</script></p>", f"<ul><li>{escaped}</li></ul>"]))
            blocks.append(t)
            if rng.random() < 0.3:
                inside.append(rng.choice([f"<form>{said(5)}<button>{word()}</button></form>", f"<div class='ad-{rng.randint(1, 9)}'>{said(20)}</div>", f"<aside><p>{said(30)}</p></aside>", f"<div class='share'><a href=x>{word()}</a></div>", "<style>p{}</style>", f"<section id='comments'><p>{said(40)}</p></section>"]))
        around = [f"<nav>{''.join(f'<a href=/{k}>{word()}</a> ' for k in range(5))}</nav>", f"<header><h1>{said(4)}</h1></header>", f"<div class='sidebar'>{said(60)}</div>", f"<div class='cookie-notice'>{said(12)}</div>"]
        rng.shuffle(around)
        rows.append((i, f"https://h{i % 4}.org/{i}", f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{''.join(around)}<article class='post-{i}'>{''.join(inside)}</article><footer>{said(30)}</footer></body></html>"))
        want[i] = "\n".join(" ".join(b.split()) for b in blocks)
    got = {r.page_id: r.main_text for r in extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert got == want


def test_empty_table(spark):
    assert extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
