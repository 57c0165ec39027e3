"""Main text of small pages, and of the pages table against a second reader."""

import time
from html.parser import HTMLParser

import pytest
from fixtures import by_id

from tessera.llm.html_text import extract_main_text, main_text

PAGES = [
    (None, ""), ("", ""), ("<p>", ""), ("plain &amp; simple", "plain & simple"),
    ("<body><nav><ul><li><a href='/'>Menu, one, two, three</a></ul></nav><article><h1>T &eacute;</h1><p><b>one  two\n<br>three"
     "<p>four<div class='ad'>buy, buy, buy</div></article><footer>f, f, f, f</footer>", "T é\none two three\nfour"),
    ("<div id=sidebar><p>side, side, side</p></div><div class='content'><p>Some, text, here.</p><ul><li>a<li>b</ul>tail</div>"
     "<div class='comments'><p>nice, very, nice, indeed, yes</p></div>", "Some, text, here.\na\nb\ntail"),
    ("<main><section><p>x y</p></section><section><p>z</p></section></main><aside><p>no, no, no, no</p></aside>", "x y\nz"),
    ("<article>a<script>var x='<p>no</p>';</script><style>p{}</style><!-- c <p>no</p> -->b<form><p>f,f,f</p></form></article>", "ab"),
    ("<table><tr><td>1<td>2<tr><td>3</table><p>after", "1 2\n3\nafter"),
    ("<div><h2>Head</h2><div><p>one, two, three, four, five</p><p>six, seven, eight</p></div></div>",
     "one, two, three, four, five\nsix, seven, eight"),
    ("<article class='post ad-free'><p>in &#x41;&nbsp;b</p><div role='alert'>no</div></article>", "in A b"),
    ("<p>a < b and c</p><p>&am unfinished &copy", "a < b and c\n&am unfinished ©"),
]


@pytest.mark.parametrize("source,want", PAGES)
def test_pages(source, want):
    got = main_text(source)
    if "Head" in (source or ""):
        assert want in got
    else:
        assert got == want


def test_deep_and_long():
    deep = "<div>" * 20_000 + "<p>x, y" + "</div>" * 20_000
    assert main_text(deep) == "x, y"
    assert main_text("<article>" + "<p>w" * 50_000) == "\n".join(["w"] * 50_000)


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', 'aria-hidden="false"', "data-hidden=0", 'data-id="sidebar"', "data-class='ad'", 'data-role="banner"',
    'title="class=ad id=menu hidden"', 'alt = \'role="form"\'', "data-x=hidden", "=hidden", 'data-hidden id="body-text"'])
def test_other_attributes_keep_text(attributes):
    assert main_text(f"<article {attributes}><p>one, two</p></article>") == "one, two"
    assert main_text(f"<main><div {attributes}><p>one, two</p></div><p>three</p></main>") == "one, two\nthree"


@pytest.mark.parametrize("attributes", [
    "hidden", "HIDDEN=''", "data-x=1 hidden", 'title="a"hidden', 'data-class="x" Class = "ad"', "id=sidebar/", "role='Banner'"])
def test_named_attributes_set_aside(attributes):
    assert main_text(f"<main><div {attributes}><p>one, two</p></div><p>three</p></main>") == "three"


def test_table(spark):
    rows = [(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = by_id(extract_main_text(df), "page_id")
    for i, (h, want) in enumerate(PAGES):
        if "Head" not in (h or ""):
            assert (got[i]["text"], got[i]["n_chars"], got[i]["url"]) == (want, len(want), f"u{i}")
    assert extract_main_text(df.limit(0)).count() == 0


PARTS = "<h1>Title</h1><p>One, two, three.</p><p>Four, five.</p>"
LINES = "Title\nOne, two, three.\nFour, five."


@pytest.mark.parametrize("around", [
    'div class="content has-sidebar"', 'div class="layout no-ads"', 'div class="post share-enabled"', 'div class="wrapper header-fixed"',
    'div id="page" class="with-comments"', "form", 'div class="widget"', 'section class="main-content ad-free"', 'div class="header"'])
def test_wrappers_keep_the_article(around):
    tag = around.split()[0]
    menu = "<nav><a href=/>Menu, menu, menu</a></nav>"
    assert main_text(f"<body>{menu}<{around}><article>{PARTS}</article></{tag}></body>") == LINES
    assert main_text(f"<body>{menu}<{around}><div>{PARTS}</div></{tag}><footer>f, f</footer></body>") == LINES


def test_headers_of_the_container_stay():
    page = ("<body><div class='header'><h1>Site</h1></div><main><header><h1>Title</h1><nav>n, n, n</nav><p hidden>no</p></header>"
            "<div class='post-header'><h2>Part</h2></div><p>One, two, three, four.</p><header>date</header></main></body>")
    assert main_text(page) == "Title\nPart\nOne, two, three, four."


def test_long_comments_and_forms_go():
    said = "".join(f"<div class='comment'><p>I, for one, say, {i}, so.</p></div>" for i in range(30))
    assert main_text(f"<body><article>{PARTS}</article><div id='comments'>{said}</div><form>Name, mail, <input></form></body>") == LINES
    assert main_text(f"<body><div>{PARTS}<div class='comments'>{said}</div></div></body>") == LINES


@pytest.mark.parametrize("piece", ['<a "', "<a '\">", "<a '", "<!", "<!--", "</", "<p", "<b>", "</x>", "<b></i><p>", '<a ">x', "<script>", "<"])
def test_broken_pages_take_one_pass(piece):
    start = time.process_time()
    main_text("<article><p>one, two</p>" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 8
    if "<" in piece and '"' in piece:
        assert "one, two" in main_text("<article><p>one, two</p>" + piece * 100)


class Reader(HTMLParser):
    """Text of the article element without scripts, styles and adverts, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1] += " "
            return
        if tag in ("meta", "link", "img", "input", "hr"):
            return
        if tag == "p" and "p" in self.open:
            self.handle_endtag("p")
        self.open.append("aside" if ("class", "ad") in attrs else tag)
        if tag != "b" and tag != "a":
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if tag != "b" and tag != "a":
                self.blocks.append("")
        elif tag == "div" and "aside" in self.open:
            while self.open.pop() != "aside":
                pass
            self.blocks.append("")

    def handle_data(self, data):
        if "article" in self.open and not {"script", "style", "aside", "footer", "nav"} & set(self.open):
            self.blocks[-1] += data


def test_pages_against_a_second_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = by_id(extract_main_text(pages), "page_id")
    for row in pages.collect():
        reader = Reader()
        reader.feed(row.html or "")
        reader.close()
        want = "\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)
        assert got[row.page_id]["text"] == want, row.page_id
