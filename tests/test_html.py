from atlaskb.config import Settings
from atlaskb.operators import html

PAGE = """<html><head><title> The <i>title</i> </title><meta name="date" content="2024-05-06T07:08"></head><body>
<nav>menu menu</nav><div class="cookie-bar">accept them</div><div id="main-content"><h1>Head</h1><p>First <b>bold</b> line
<p>Home<p>abc<aside>gone gone</aside><p>Servizio attivo</div><footer>bottom text</footer></body></html>"""


def test_page_text_and_title():
    assert html.page_text(PAGE) == "Head\nFirst\nbold\nline\nServizio attivo"
    assert html.page_title(PAGE) == "Thetitle"
    assert html.page_title("<h1>Only</h1>") == "Only"
    assert html.page_title("") == "" and html.page_text(None) == ""


def test_container_order():
    assert html.page_text("<body>rest text<article>article text</article></body>") == "article text"
    assert html.page_text("<body><article>article text</article><main>main text</main></body>") == "main text"
    assert html.page_text("<p>no container") == ""


def test_dates_and_status():
    assert html.page_date(PAGE) == "2024-05-06"
    assert html.page_date('<meta property="article:modified_time" content="2023-01-02"><meta name="date" content="x">') == "2023-01-02"
    assert html.page_date('<time datetime="2022-02-03T00:00">x</time>') == "2022-02-03"
    assert html.page_date("<p>x") is None
    assert html.service_status(PAGE) == "attivo" and html.service_status("servizio  sospeso") is None
    assert html.service_status("<p>Servizio sospeso") == "non attivo"


def test_clean_pages(spark):
    pages = spark.createDataFrame([("https://suap.x.example/services/1", PAGE), ("https://x.example/", None)], "url string, html string")
    rows = {r.url: r for r in html.clean_pages(pages).collect()}
    first = rows["https://suap.x.example/services/1"]
    assert (first.category, first.section, first.date, first.service_status) == ("servizio", "suap", "2024-05-06", "attivo")
    assert rows["https://x.example/"].text == ""


def test_links(spark):
    page = '<a href="b">1</a><a class=x href=\'/c.pdf\'>2</a><a href="mailto:x@y">3</a><a href="b#f">4</a><a href="https://far.example/z.PDF">5</a><a href="?page=1">6</a>'
    pages = spark.createDataFrame([("https://s.example/a", page)], "url string, html string")
    s = Settings(allowed_domains=("s.example",))
    assert [r.link for r in html.links(pages, s).orderBy("position").collect()] == ["https://s.example/b", "https://s.example/c.pdf", "https://s.example/b"]
    assert [r.link for r in html.pdf_links(pages, s).collect()] == ["https://s.example/c.pdf"]
