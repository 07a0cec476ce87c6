import time

import pytest

from tablestats.llm import html_text

PARA = "A first paragraph, with commas, and some words in it, so that it scores well."


@pytest.mark.parametrize("page,text", [
    ("", ""),
    ("plain <b>words</b>", "plain words"),
    (f"<html><body><nav><a href=x>Menu</a></nav><div id=main><h1>T &amp; U</h1><p>{PARA}<p>two<br>lines &lt;x&gt;</div><footer>foot</footer></body>", f"T & U\n{PARA}\ntwo lines <x>"),
    (f"<article><h1>H</h1><p><b>bold {PARA}<br><p>next</p></article><aside>side, side, side, side</aside>", f"H\nbold {PARA}\nnext"),
    (f"<div><p>{PARA}</p><div class='comments'><p>Nice, nice, nice, nice, nice</p></div><script>var a='</p>';</script><style>p{{}}</style>end</div>", f"{PARA}\nend"),
    (f"<main><p>{PARA}</p><form><input><button>Go</button></form><div class=\"cookie-notice\">We use cookies, yes</div><ul><li>one<li>two</ul></main>", f"{PARA}\none\ntwo"),
    (f"<div class=sidebar>{PARA}</div><div class=story><p>{PARA} It goes on.</p></div>", f"{PARA} It goes on."),
    (f"<p>{PARA}</p><!-- a <p>comment</p> --><p>AT&ampT &#233;&nbsp;&#x41;</p>", f"{PARA}\nAT&T é A"),
    (f"<div class='page has-sidebar no-comments'><p>{PARA}</p><figure><img><figcaption>A caption</figcaption></figure></div>", f"{PARA}\nA caption"),
    (f"<table><tr><td>{PARA}<td>second<tr><td>third</table>", f"{PARA}\nsecond\nthird"),
    ("<ul><li><a href=1>only, links, here</a></li></ul>", ""),
    ("<div><div><div><div><p>deep, deep, deep text</div>", "deep, deep, deep text"),
    ("</p></div><p>stray, ends</p><", "stray, ends\n<"),
])
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_query(spark):
    rows = [(1, "u", f"<article><p>{PARA}</p></article>"), (2, None, None), (None, "v", ""), (1, "u", f"<article><p>{PARA}</p></article>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_text.extract(pages).collect()]
    assert got == [(1, "u", PARA, len(PARA)), (2, None, "", 0), (None, "v", "", 0), (1, "u", PARA, len(PARA))]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_very_long_page():
    page = "<article>" + f"<p>{PARA}</p>" * 20_000 + "</article>"
    assert html_text.main_text(page) == "\n".join([PARA] * 20_000)


def test_deep_nesting_is_no_recursion():
    assert html_text.main_text("<div>" * 5000 + PARA) == PARA


@pytest.mark.parametrize("page,text", [
    (f"<article><h2 id=related-work>Related work</h2><p>{PARA}</p><section id='social-effects'><h3>Social</h3><p>Short.</p></section></article>", f"Related work\n{PARA}\nSocial\nShort."),
    (f"<body><div class='post comments-open'><h1 id=comments>T</h1><p class=notice>{PARA}</p></div></body>", f"T\n{PARA}"),
    (f"<article><p title='The hidden cost'>{PARA}</p><p>see <a href=x title=\"A hidden gem\">these words</a> too <a href=/a/hidden/b>b</a></p></article>", f"{PARA}\nsee these words too b"),
    (f"<article><p>{PARA}</p><p hidden>no</p><p HIDDEN=''>no</p><div class=x hidden=until-found>no</div><p data-hidden=1 alt=hidden>yes</p>one <span hidden>no</span>two</article>", f"{PARA}\nyes\none two"),
    (f"<article><p>{PARA} <span class='share'>some</span> <a class=social-link href=x>words</a> on.</p><pre><span class=hljs-comment># code</span></pre></article>", f"{PARA} some words on.\n# code"),
    (f"<article><p>{PARA}</p><div><a class=share-button href=x>Share</a> <a class=share-button href=y>Post</a></div></article>", PARA),
    (f"<article><p>{PARA}</p><div class=related-stories><p><a href=x>{PARA}</a></p></div><div class='promo-inline'>Buy now</div><div class=share-buttons><p>{PARA}</p></div></article>", PARA),
    (f"<body><div class=widget><p>{PARA}</p><p>{PARA}</p></div><p>end</p></body>", f"{PARA}\n{PARA}\nend"),
    (f"<article><div><img class=banner>A caption</div><p>{PARA}</p></article>", f"A caption\n{PARA}"),
    (f"<article><p>{PARA}</p><div id=comments class=comments-area>" + f"<p>{PARA}</p>" * 30 + "</div></article>", PARA),
])
def test_class_and_id_words_and_attribute_names(page, text):
    assert html_text.main_text(page) == text


LONG = f"<div><p>{PARA}</p><p>{PARA}</p><p>{PARA}</p></div>"
THREE = "\n".join([PARA] * 3)


@pytest.mark.parametrize("page,text", [
    (f"<body>{LONG}<blockquote>quote</blockquote><div><p>short last paragraph</p></div></body>", f"{THREE}\nquote\nshort last paragraph"),
    (f"<body><h4>Title</h4>{LONG}<ul><li>one<li>two</ul><ol><li>three</ol><pre>code</pre><dl><dt>t<dd>d</dl><figure><figcaption>cap</figcaption></figure><table><tr><td>cell</table><section>end</section></body>",
     f"Title\n{THREE}\none\ntwo\nthree\ncode\nt\nd\ncap\ncell\nend"),
    (f"<body><div><div>{LONG}</div></div><blockquote>quote</blockquote>bare <b>words</b><p>p</p></body>", f"{THREE}\nquote\nbare words\np"),
    (f"<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul>{LONG}<div>See <a href=3>many more of these stories here</a></div><div class=sidebar>{PARA}</div><a href=4>top</a><footer>foot</footer></body>", THREE),
])
def test_parts_beside_the_best_container(page, text):
    assert html_text.main_text(page) == text


COMMENT = f"<article class=comment><p>{PARA} {PARA}, and, more, of, it.</p></article>"


@pytest.mark.parametrize("page,text", [
    # Reader comments as articles, beside the article and inside it.
    (f"<main><article><p>{PARA}</p></article><section><h2>Comments</h2>{COMMENT}{COMMENT}</section></main>", PARA),
    (f"<main><article><p>Short one.</p></article><section><h2>Comments</h2>{COMMENT * 9}</section></main>", "Short one."),
    (f"<article><h1>T</h1><p>{PARA}</p><h3>Comments</h3><article class='comment reply'><p>{PARA}</p></article></article>", f"T\n{PARA}"),
    (f"<div class=post><h2>T</h2><p>{PARA}</p></div><h2>What readers say</h2><div class=comments>{COMMENT}</div>", f"T\n{PARA}"),
    (f"<article class=notice><h1>T</h1><p>{PARA}</p></article><footer>foot</footer>", f"T\n{PARA}"),
    (f"<article class='post no-sidebar widget'><p>{PARA}</p></article>", PARA),
    (f"<article><p>{PARA}</p><h2>End</h2></article><div class=comments><p>no</p></div>", f"{PARA}\nEnd"),
    # Quotes open a value right after an equals sign only.
    (f"<article><p>{PARA}</p><p data-x=don't>Hello, it's fine here.</p><p it's=1>two</p></article>", f"{PARA}\nHello, it's fine here.\ntwo"),
    (f"<article><p>{PARA}</p><a href=/x?a='b'&c=\"d>e>f</a></article>", f"{PARA}\ne>f"),
    (f"<article><p title='a > b' data-y = \"c > d\">{PARA}</p><p title=>x</p><p a==b>y</p></article>", f"{PARA}\nx\ny"),
    (f"<article><p>{PARA}</p><p title=\"abc>lost</p><p>after</p></article>", f"{PARA}\nlost\nafter"),
    (f"<article><p>{PARA}</p><p title=abc", PARA),
    # Hidden inline elements with others of their name inside, and without an end.
    (f"<article><p>{PARA}</p><p>a <span hidden>secret <span>inner</span> leak</span>b</p></article>", f"{PARA}\na b"),
    (f"<article><p>{PARA}</p><p>a <span hidden>secret <b>bold</b><p>after</p><i hidden>x<div>y</div></i>z</article><p>end</p>", f"{PARA}\na\nafter\nz\nend"),
    (f"<article><p>{PARA}<img hidden> on</p><a hidden href=x>no <a>no</a></a><a href=y>yes</a></article>", f"{PARA} on\nyes"),
    # A header inside an article goes as any other.
    (f"<article><header><h1>Title</h1></header><p>{PARA}</p></article>", PARA),
    # A menu that is never closed ends where the next larger container starts.
    (f"<nav><ul><li><a href=x>Menu</a></ul><article><p>{PARA}</p></article>", PARA),
    (f"<NAV><a href=x>Menu</a><DIV><p>{PARA}</p></DIV><footer>foot<aside>side</aside>", PARA),
])
def test_markup_read_as_meant(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + PARA, "<ul><li>" * 25_000 + PARA, "<x>" * 50_000 + PARA + "</p></y>" * 50_000, f"<div class=share><p>{PARA}" * 20_000,
                                  f"<p>{PARA}</p><div>{PARA}</div>" * 20_000, "<nav><div>" * 20_000 + PARA, "<span hidden>" * 50_000 + PARA, "<p a='" * 30_000 + PARA, "<li>" + "<div></li>" * 30_000 + PARA])
def test_time_grows_with_the_page(page):
    at = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - at < 5
