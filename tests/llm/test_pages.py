"""Main text of pages."""

from pyspark.sql import functions as F

from panelworks.llm.html_style_tree import extract, importances, main_text, parse, style_counts, with_host

PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header>top</header>'
    '<nav><ul><li><a href="/x">menu</a></ul></nav><div class="sidebar"><p>side</p></div><div class="ad-box">buy</div>'
    "<article><h1>Title &amp; more</h1><p><b>First<br>line.<p>a  <i>b</i>c&eacute;&nbsp;d</p>"
    '<form><input value="q">search</form><div class="cookie notice">cookies</div><ul><li>one<li>two</ul>'
    '<section id="comments"><p>reader</p></section></article><!-- gone --><footer>foot</footer></body></html>'
)


def test_main_text_of_one_page():
    assert main_text(parse(PAGE), set()) == "Title & more\nFirst line.\na bcé d\none\ntwo"


def test_broken_markup():
    assert main_text(parse("<p>1 < 2 and <b>x<p>y <!-- never closed"), set()) == "1 < 2 and x\ny"
    assert main_text(parse("<div>a<script>if (1<2) {"), set()) == "a"
    assert main_text(parse('<div class="x>broken'), set()) == "broken"
    assert main_text(parse("</p></div>plain"), set()) == "plain"


def _host(n):
    boiler = '<div class="xq"><p>Read all our stories here</p></div>'
    return [(i, f"http://h.example/{i}", f'<body>{boiler}<div class="zz"><p>Story number {i} of many words {i * 7}</p></div></body>') for i in range(n)]


def test_low_branches_go_and_rare_hosts_stay(spark):
    rows = [*_host(40), (900, "http://rare.example/1", _host(1)[0][2]), (901, None, "<p>no url</p>"), (902, "not a url", None), (903, "http://h.example/x", ""), (0, *_host(1)[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("low", F.lit(1))
    found = extract(pages).collect()
    assert len(found) == len(rows)
    text = {r["page_id"]: r["text"] for r in found}
    assert all(text[i] == f"Story number {i} of many words {i * 7}" for i in range(40))
    assert text[900] == "Read all our stories here\nStory number 0 of many words 0"
    assert (text[901], text[902], text[903]) == ("no url", "", "")
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert extract(pages.limit(0)).count() == 0


def test_importance_is_low_where_texts_repeat(spark):
    pages = spark.createDataFrame(_host(30), "page_id long, url string, html string")
    values = sorted(r["importance"] for r in importances(style_counts(with_host(pages))).collect() if r["n_pages"] == 30)
    assert values[0] == 0 and values[-1] > 0.8


def test_an_article_stays_where_most_blocks_are_menu(spark):
    menu = "".join(f'<li class="it{k}">menu item {k}</li>' for k in range(30))
    own = lambda i: [f"Paragraph {k} of page {i}" for k in range(5)]
    page = lambda i: f'<html><body><div class="wrap"><ul class="mm">{menu}</ul><div class="zz">{"".join(f"<p>{x}</p>" for x in own(i))}</div></div></body></html>'
    pages = spark.createDataFrame([(i, f"http://m.example/{i}", page(i)) for i in range(40)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract(pages).collect()} == {i: "\n".join(own(i)) for i in range(40)}


def test_blocks_outside_by_meaning_do_not_count(spark):
    nav = "".join(f"<li>menu item {k}</li>" for k in range(30))
    rows = [(i, f"http://n.example/{i}", f'<body><nav><ul>{nav}</ul></nav>Own text {i}</body>') for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    values = [r["importance"] for r in importances(style_counts(with_host(pages))).collect()]
    assert len(values) == 1 and values[0] > 0.8


def test_few_pages_are_weaker_evidence_not_none(spark):
    rows = [(i, f"http://h{n}.example/{i}", html) for n in (1, 2, 3, 9) for i, _, html in _host(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = {(r["url"].split("/")[2], r["text"].startswith("Read all")) for r in extract(pages).collect()}
    assert kept == {("h1.example", True), ("h2.example", True), ("h3.example", False), ("h9.example", False)}


def test_copies_in_many_partitions_count_once(spark):
    page = lambda i: f'<body><div class="zz"><p>Story number {i}</p></div></body>'
    rows = [(i, f"http://c.example/{i}", page(max(0, i - 9))) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 12):
        found = extract(pages.repartitionByRange(parts, "page_id")).collect()
        assert {r["page_id"]: r["text"] for r in found} == {i: f"Story number {max(0, i - 9)}" for i in range(12)}


def test_role_words_do_not_take_the_main_text():
    for html, text in (
        ('<div class="content with-sidebar"><p>one</p></div>', "one"),
        ('<article class="post no-comments"><div class="article-header"><h1>title</h1></div><p>one</p></article>', "title\none"),
        ('<article class="comment"><p>one</p></article>', "one"),
        ('<div class="search"><main><p>one</p></main></div><p class="share">two</p>', "one"),
        ('<header><article>one</article></header>', "one"),
        ('<main>one<div class="comments"><article>two</article></div></main>', "one"),
        ('<div class="sidebar x">one</div><div id="Search">two</div><div>three</div>', "three"),
        ('<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p><svg class="i"/><svg><text>label</text></svg></article>', "If x=2 then\nlabel"),
    ):
        assert main_text(parse(f"<body>{html}</body>"), set()) == text


def test_the_tree_decides_on_parts_of_class_words(spark):
    page = '<body><div class="site-header"><p>Our paper</p></div><div class="page with-sidebar"><p>Story number {}</p></div></body>'
    pages = spark.createDataFrame([(i, f"http://p.example/{i}", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract(pages).collect()} == {i: f"Story number {i}" for i in range(12)}
