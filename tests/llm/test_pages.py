"""Main text by tag paths and WARC derivatives."""

import hashlib
import html
import math
import re

import duckdb
import pytest

from vigilake.llm import tag_paths, warc


def simple_article(page):
    """For the plain pages of the fixture: the article's parts by splitting at block tags."""
    inner = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.S)
    parts = re.split(r"</?(?:p|h1|article)>", inner[1]) if inner else []
    parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", lambda m: " " * (m[0] == "<br>"), p)).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_query_matches_simple_split(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    out = tag_paths.query(spark, data).collect()
    assert len(out) == len(pages)
    for r in out:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, simple_article(pages[r.page_id].html), len(r.text))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><p>a&amp;b &#233;&eacute; &lt;x&gt;<p>c\n\t d</article>", "a&b éé <x>\nc d"),
        ("<nav>menu</nav><main><h2>T</h2>text<div class='side comments'><p>Great!</p></div><form>f</form></main><footer>x</footer>", "T\ntext"),
        ("<body><article><header>by me</header><p>one <b>two</b>, three<br>four</p><aside>ad</aside><!-- <p>no</p> --><script>'<p>'</script></article>", "one two, three four"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", "a\nb\n1\n2"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p id='ad'>buy</p><p hidden>h</p><p role=alert>r</p><p style='display: none'>s</p><p>keep</article>", "keep"),
        ("<article><p>5 < 6 and <b unclosed", "5 < 6 and"),
    ],
)
def test_pages(page, text):
    assert tag_paths.main_text(page) == text


def test_ratios_choose_without_article():
    body = "".join(f"<p>Sentence {k}, with some length; and, points. Here it goes on, and on.</p>" for k in range(12))
    links = "".join(f"<li><a href=x>link {k}</a></li>" for k in range(20))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Title</h1>{body}</div><div><span>tiny</span></div></body>"
    assert tag_paths.main_text(page).split("\n")[0] == "Title"
    assert tag_paths.main_text(page).count("\n") == 12


def test_ratios_decide_beside_a_teaser():
    body = [f"Sentence {k}, with some length; and, points. Here it goes on, and on." for k in range(12)]
    text = "".join(f"<p>{b}</p>" for b in body)
    page = f"<body><article class=card><h3>Next</h3><p>Read it</p></article><div><h1>Title</h1>{text}</div><div><span>tiny</span></div></body>"
    assert tag_paths.main_text(page) == "\n".join(["Title", *body])
    page = f"<body><div><p>small print, beside</p></div><main><h1>Title</h1>{text}<ul><li>a</ul></main></body>"
    assert tag_paths.main_text(page) == "\n".join(["Title", *body, "a"])


@pytest.mark.parametrize("start", ["<div class='main has-sidebar'>", "<article class='post no-comments'>", "<div id='search-result-article'>", "<section class='legal'>"])
def test_names_are_whole_and_spare_the_heaviest_path(start):
    body = [f"Sentence {k}, with some length; and, points. Here it goes on, and on." for k in range(12)]
    text = "".join(f"<p>{b}</p>" for b in body)
    page = f"<body><div class='ad'>buy this, now</div>{start}{text}<div class='comments'><p>Great!</p></div></{start[1:].split()[0]}></body>"
    assert tag_paths.main_text(page) == "\n".join(body)


BODY = [f"Sentence {k}, with some length; and, points. Here it goes on, and on." for k in range(12)]
TEXT = "".join(f"<p>{b}</p>" for b in BODY)


@pytest.mark.parametrize(
    "side",
    [
        '<section class="comments-area"><h3>Comments</h3><p>Great read, thanks; I liked it, really. More, please.</p></section>', '<div class="sidebar-left"><p>About us, and more. Read, please.</p></div>',
        '<div id="siteFooter"><p>All, of us.</p></div>', '<div class="post-comments"><p>First! I say, first.</p></div>', '<div class="x left_sidebar y"><p>About us, and more.</p></div>', '<ul class="social-links"><li>us</li></ul>',
        '<div class="cookie-banner"><p>We use cookies, as all do.</p></div>', '<section><h2>3 Comments</h2><div><p>Great read, thanks; I liked it.</p></div></section>', '<h3>Kommentare</h3><p>Sehr gut, danke.</p>',
    ],
)
@pytest.mark.parametrize("inside", [True, False])
def test_compound_names_and_readers(side, inside):
    page = f"<body><article><h1>T</h1>{TEXT}{side if inside else ''}</article>{'' if inside else f'<div>{side}</div>'}</body>"
    assert tag_paths.main_text(page) == "\n".join(["T", *BODY])


@pytest.mark.parametrize("name", ["no-comments", "has-sidebar", "without-ads", "post-header", "entry-header", "header-image-note", "readings", "comment", "commented-code"])
def test_names_that_are_none(name):
    """What only sounds like chrome stays, however short."""
    page = f"<body><article><div class='{name}'><h2>Part</h2><p>One short line, here.</p></div>{TEXT}</article></body>"
    assert (tag_paths.main_text(page) == "\n".join(["Part", "One short line, here.", *BODY])) == (name != "comment")


def test_a_text_about_comments():
    page = f"<body><article><h1>Comments in code</h1>{TEXT}<h2>Comments</h2>{TEXT}<h2>The end</h2><p>Last, at last.</p></article></body>"
    assert tag_paths.main_text(page).startswith("Comments in code\n" + "\n".join(BODY)) and tag_paths.main_text(page).endswith("The end\nLast, at last.")


def slow_scores(rows):
    """The ratios of each block's path, worked out block by block."""
    out = []
    for _, path, chrome, inside, _ in rows:
        mine = [t for t, p, *_ in rows if p == path]
        points = sum(not (c.isalnum() or c == "_" or c.isspace()) for t in mine for c in t)
        n = len(mine)
        ratio = sum(map(len, mine)) / n * math.log2(2 + points / n) * math.log2(1 + n)
        out.append(0.0 if chrome else ratio * (2 if inside else 1))
    total = sum(math.exp(-d * d / 2) for d in range(-2, 3))
    smooth = [sum(out[k + d] * math.exp(-d * d / 2) / total for d in range(-2, 3) if 0 <= k + d < len(out)) for k in range(len(out))]
    return [math.sqrt(a * b) for a, b in zip(out, smooth, strict=True)]


def test_ratios_by_brute_force(spark, data):
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").limit(40).collect()]
    pages += [f"<body><div><ul><li>a<li>b, c</ul>{TEXT}</div><nav>x</nav></body>", f"<main>{TEXT}</main><p>one; two_three</p>"]
    for page in pages:
        rows = tag_paths.blocks(page)
        assert tag_paths.path_scores(rows).tolist() == pytest.approx(slow_scores(rows))


def test_headline_in_the_header_of_an_article():
    assert tag_paths.main_text("<header><h1>Site</h1></header><article><header><h1>T</h1><p>by me</p></header><p>one</article>") == "T\none"


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<main>" + "<p>ab</p>" * 20000, "x"), (1, "u", "<main>a", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in tag_paths.extract(df).collect()) == [0, 1, 59_999]
    assert tag_paths.extract(df.limit(0)).count() == 0


def test_derivatives_match_sql(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").toPandas()
    con = duckdb.connect()
    con.register("pages", pages)
    rows = sorted(map(tuple, warc.query(spark, data).collect()), key=str)
    assert rows == sorted(con.execute(warc.ORACLE).fetchall(), key=str)


def test_derivatives_link_to_their_response(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x &amp; é</p>", 0), (2, None, None, 0), (None, "u", "", 0)], "page_id long, url string, html string, block int")
    source = warc.responses(df)
    by_id = {r.record_id: r for r in source.collect()}
    rows = warc.derive(source.unionByName(warc.derive(source))).collect()
    assert len(rows) == 6
    for r in rows:
        origin = by_id[r.refers_to]
        assert (r.refers_to_uri, r.refers_to_date, r.page_id) == (origin.target_uri, origin.warc_date, origin.page_id)
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode())
        if r.warc_type == "metadata":
            assert f"source-block-digest: {origin.block_digest}\r\n" in r.block and "http-header: Content-Type: text/html" in r.block
        elif r.page_id == 1:
            assert r.block == "x & é"
    text = {r.record_id: r.record for r in warc.serialise(source).collect()}
    for name, record in text.items():
        head, _, rest = record.partition("\r\n\r\n")
        length = int(re.search(r"Content-Length: (\d+)", head)[1])
        assert head.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and f"WARC-Record-ID: {name}" in head
        assert rest.encode()[length:] == b"\r\n\r\n"
    assert warc.derive(source.limit(0)).count() == 0


def test_text_of_unclosed_and_very_long_pages():
    assert warc.plain_text("a<script>if (x < 1) { y }") == "a" and warc.plain_text("a<!-- b") == "a" and warc.plain_text("a<style>p {}</style>b") == "ab"
    long = "<p>word &amp; word</p>" * 200_000
    assert warc.plain_text(long) == "\n".join(["word & word"] * 200_000)
