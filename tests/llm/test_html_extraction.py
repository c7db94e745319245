import time

import pytest
from sentimetry.llm import html_extraction as op

ARTICLE = "<h1>Title here</h1><p>First paragraph, with some text in it. And more of it.</p><p>Second one;\n   also &amp; long enough, I think.</p><p>Yes.</p>"
TEXT = "Title here\n\nFirst paragraph, with some text in it. And more of it.\n\nSecond one; also & long enough, I think.\n\nYes."
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav>"


@pytest.mark.parametrize("page", [
    f"<!DOCTYPE html><html><head><title>T</title><style>p{{a>b}}</style><script>var t='</p>';</script></head><body>{MENU}<!-- ad --><div class=\"ad\">Buy this. Now, please.</div><article>{ARTICLE}</article><footer>&copy; 2020, someone. All rights, reserved.</footer></body></html>",
    f"<body><header><h1>Site name</h1><p>The best site, ever. Really good.</p></header><main>{ARTICLE}</main><aside><p>Read this, too. And that, as well.</p></aside>",
    f"<body><div id='menu'><a href=x>One</a> <a href=y>Two</a></div><div class='content'>{ARTICLE}</div><div class='sidebar'><p>Other things, to be read. Many of them.</p></div><div id=footer>Imprint, terms.</div></body>",
    f"<body><article>{ARTICLE}<section class='comments'><h2>Comments</h2><p>I like it, very much. Thank you!</p></section></article><form><p>Your name, please.</p><input><button>Send</button></form>",
    f"<body><div class='cookie-notice'><p>We use cookies, as all do. Is that fine, for you?</p></div><article>{ARTICLE}<div class='share-buttons'><a href=x>Share</a></div></article><div class='related'><p>See also, this one. And that.</p></div>",
    f"<body><div role='navigation'>Home, news.</div><div hidden><p>Hidden text, here. And more, of it.</p></div><div><div>{ARTICLE}</div></div><noscript>Enable scripts, please.</noscript>",
    f"<ARTICLE>{ARTICLE.replace('<p>', '<P ALIGN=left>').replace('</p>', '')}</ARTICLE><FOOTER>x</FOOTER>",
])
def test_article_alone(page):
    assert op.extract(page) == TEXT


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("just text, no tags", "just text, no tags"), ("<p>a<br>b&nbsp;&nbsp; c</p>", "a b c"), ("<article><p>f<b>oo</b>bar<i> x</i></p></article>", "foobar x"),
    ("<article><p><b>Bold title<br><p>Then text, here.</p></article>", "Bold title\n\nThen text, here."), ("<article>open <a title='a > b' href=\"x\">link</a> text", "open link text"),
    ("<article><p>1 < 2 &lt; 3 &#8364; &eacute;</p>", "1 < 2 < 3 € é"), ("<article><ul><li>one, two<li>three, four</ul></article>", "one, two\n\nthree, four"),
    ("<article><p>cut <a href=\"never closed", "cut"), ("<script>only", ""), ("<article><p>x</p><script src=a></script><p>y</p></article>", "x\n\ny"),
    ("<article><p>same.</p><p>same.</p></article>", "same.\n\nsame."), ("<nav>only a menu</nav>", ""), ("<article><p></p></article>", ""),
])
def test_details(page, text):
    assert op.extract(page) == text


def test_long_page_and_deep_nesting():
    many = "".join(f"<p>Paragraph {i}, of many. Each is kept.</p>" for i in range(3000))
    assert op.extract(f"<article>{many}</article>").count("\n\n") == 2999
    assert op.extract("<div>" * 3000 + "<p>deep, text. here.</p>") == "deep, text. here."


BODY = "".join(f"<p>Paragraph {i}, one of many here. It goes on, and on.</p>" for i in range(40))
BODY_TEXT = [f"Paragraph {i}, one of many here. It goes on, and on." for i in range(40)]


@pytest.mark.parametrize("page, text", [
    (f"<body>{MENU}<div><h1>Title</h1><div class=lead><p>A short lead.</p></div><div class=text>{BODY}</div></div><div class=footer>Imprint.</div></body>", ["Title", "A short lead.", *BODY_TEXT]),
    (f"<article>{BODY}<h2>References</h2><ul><li><a href=x>One source</a></li><li><a href=y>Another</a></li></ul></article>", [*BODY_TEXT, "References", "One source", "Another"]),
    *((f"<body>{MENU}<div class='{c}'>{BODY}</div><div class=sidebar><p>Other, things. Many, of them.</p></div></body>", BODY_TEXT) for c in ("content with-sidebar", "no-sidebar", "side-by-side", "has_menu page")),
    (f"<body>{MENU}<div><section>{BODY}</section><section><p>Short end.</p></section></div></body>", [*BODY_TEXT, "Short end."]),
    (f"<article>{BODY}<aside><blockquote>It was said.</blockquote></aside><aside class=pullquote>Said twice.</aside><aside><p>See also, this. And that.</p></aside></article>", [*BODY_TEXT, "It was said.", "Said twice."]),
])
def test_article_is_kept_whole(page, text):
    assert op.extract(page) == "\n\n".join(text)


@pytest.mark.parametrize("page", ["<div>" * 20000 + "deep, text.", "<b>" * 3000 + "</i>" * 20000 + "deep, text.", "<div>" * 3000 + "</p></span>" * 20000 + "deep, text.", "<li>" * 20000 + "deep, text."])
def test_malformed_pages_take_no_square_time(page):
    begin = time.process_time()
    assert op.extract(page) == "deep, text."
    assert time.process_time() - begin < 2


def test_query_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", 5), (1, "u", f"<article>{ARTICLE}</article>", 5), (None, None, None, 6)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, op.main_text(pages).collect()), key=repr) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0)], key=repr)
    assert op.main_text(pages.where("false")).collect() == []
