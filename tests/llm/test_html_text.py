import html
import re

from loomdex.llm.html_text import deduce_templates, extract_main_text, main_text, op9_main_text, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="nav-open">
<header>Site</header><nav><ul><li><a href="/">Home</a><li>More</ul></nav><!-- <p>no</p> --><div class="ad box">Buy</div>
<article class="post"><header><h1>Head&amp;line</h1></header><p>One <b>bo</b>ld<br>two &eacute;&#233;&nbsp;x<p>Three<aside>side</aside>
<form>name <input></form><div id="comments"><p>reader</p></div><div class="cookie-notice">We use</div><ul><li>a<li>b</ul></article>
<footer>&copy; end</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE, set()) == "Head&line One bold two éé x Three a b"
    assert main_text(None, set()) == main_text("", set()) == main_text("<nav>x</nav>", set()) == ""
    assert main_text("<article>a < b & c <p title='>'>d</article", set()) == "a < b & c d"
    assert main_text("<main><p>m</p></main><div>out</div>", set()) == "m"
    assert len(parse("<div>" * 3000 + "x" + "y " * 100000)[1]) == 1


def test_query_equals_the_articles(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op9_main_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>)", pages[r["page_id"]]["html"], re.S)
        inline = re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", article[1])
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inline)).split())
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == pages[r["page_id"]]["url"]


def test_template_texts_are_deduced_where_no_element_tells(spark):
    page = lambda i: f"<body><div><div>Welcome to us</div><div>All rights</div><div>Story {i} begins</div><p>and ends {i * 7}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page(i), 0) for i in range(8)] + [(9, None, None, 1), (9, None, None, 1), (None, "nohost", "<p>x", 2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r["page_id"], r["text"]) for r in extract_main_text(frame).collect()}
    assert got == {(i, f"Story {i} begins and ends {i * 7}") for i in range(8)} | {(9, ""), (None, "x")}
    assert extract_main_text(frame.limit(0)).count() == 0
    deduced = deduce_templates(frame.selectExpr("1L AS host", "page_id AS page", "html").where("page < 8"))
    assert deduced.count() >= 4 and deduced.where("container").count() == 1


def extracted(spark, pages):
    rows = [(f"p{i}", "http://h.example/", p) for i, p in enumerate(pages)]
    return [r["text"] for r in sorted(extract_main_text(spark.createDataFrame(rows, "page_id string, url string, html string")).collect(), key=lambda r: int(r["page_id"][1:]))]


def test_the_template_decides_inside_the_article(spark):
    """A notice that every article of the host has goes, without any name; a page's own element of a telling name stays."""
    page = lambda i: f"<body><nav>Menu</nav><article><h1>Title {i}</h1><div>You may copy this page.</div><p>Story {i} goes on and on to its end.</p>{'<p class=share>A share of stock fell.</p>' if i == 3 else ''}<div class=related>Read this too</div></article></body>"
    got = extracted(spark, [page(i) for i in range(8)])
    assert got == [f"Title {i} Story {i} goes on and on to its end." + (" A share of stock fell." if i == 3 else "") for i in range(8)]
    # without a template nothing tells the notice from the story, and names decide
    assert main_text(page(3), set()) == "Title 3 You may copy this page. Story 3 goes on and on to its end."


def test_copies_of_one_article_are_not_a_template(spark):
    same = "<body><nav>Menu</nav><article><h1>One title</h1><p>One story that several pages tell.</p></article><footer>End</footer></body>"
    other = lambda i: f"<body><nav>Menu</nav><article><h1>Title {i}</h1><p>Story {i}.</p></article><footer>End</footer></body>"
    got = extracted(spark, [same] * 6 + [other(i) for i in range(3)])
    assert got == ["One title One story that several pages tell."] * 6 + [f"Title {i} Story {i}." for i in range(3)]


def test_templates_nest(spark):
    """A text counts as the template's only if all elements around it do."""
    page = lambda i: f"<body><div class=a><div>Top line</div><div>Second line</div></div><section class=s{i}><div>Top line</div><p>Tale {i}</p></section></body>"
    assert extracted(spark, [page(i) for i in range(6)]) == [f"Top line Tale {i}" for i in range(6)]


def test_main_beside_a_teaser():
    assert main_text("<main><article><p>Tease</p></article><p>A long body text that is the page's own matter and goes on</p></main>", set()) == "Tease A long body text that is the page's own matter and goes on"


def neutral(page):
    """A page whose elements tell nothing: those of articles and asides are plain ones, and there are no names."""
    plain = re.sub(r"<(/?)(?:article|main|nav|footer|header|aside|form|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(?:class|id|role)=(?:"[^"]*"|'[^']*')""", "", plain)


def test_classes_find_the_article_where_elements_tell_nothing(spark, sf_dir):
    """On the given pages without telling elements the template's container holds the article, and without the template nothing does."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    frame = spark.createDataFrame([(r["page_id"], r["url"], neutral(r["html"])) for r in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(frame).collect()}
    want = {r["page_id"]: main_text(r["html"], set()) for r in pages}
    right = sum(got[i] == want[i] for i in want) / len(want)
    empty = sum(main_text(neutral(r["html"]), set()) == want[r["page_id"]] for r in pages) / len(want)
    assert right >= 0.9 and empty == 0, (right, empty)


def test_small_hosts_are_pooled_by_layout(spark):
    """No host has enough pages for a template, but their pages have one layout."""
    page = lambda i: f"<body><div>Menu {i} of links</div><div><h2>Tale {i}</h2><p>Once upon a time there were {i} tales.</p><p>They went on and on, {i} times, to the end.</p></div><div>Imprint {i}</div></body>"
    frame = spark.createDataFrame([(i, f"http://h{i}.example/", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(frame).collect()}
    assert got == {i: f"Tale {i} Once upon a time there were {i} tales. They went on and on, {i} times, to the end." for i in range(12)}


def test_joined_templates_give_what_broadcast_ones_do(spark, sf_dir, monkeypatch):
    import loomdex.llm.html_text as module

    rows = lambda: sorted(tuple(r) for r in op9_main_text(spark, sf_dir).collect())
    broadcast = rows()
    monkeypatch.setattr(module, "BROADCAST_TOKENS", 0)
    assert rows() == broadcast
