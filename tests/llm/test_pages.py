import hashlib
import random

from pyspark.sql import functions as F

from gapwright.llm import main_text, scratch, warc
from gapwright.llm.main_text import Page

LONG = "A sentence of the article that goes on for a while, so that it counts. " * 4


def text(html):
    return Page(html).text(None)


def test_blocks_references_and_white_space():
    page = f"<body><article><h1>Fish &amp;\n chips</h1><p>{LONG}<b>a&nbsp;b<br>c</b><p>two&lt;3 &#x41;&eacute; &am</article></body>"
    assert text(page) == f"Fish & chips\n{' '.join(LONG.split())} a b c\ntwo<3 Aé &am"


def test_side_matter_goes():
    page = f"""<html><head><title>no</title><style>p>a{{}}</style></head><body class="has-sidebar"><header>no</header><nav><a href=x>no</a></nav>
      <div class="cookie-notice">no</div><div id="sidebar">no</div><main><article class="post no-comments"><header><h1>Title</h1></header><p>{LONG}</p>
      <script>var t="</p>";no()</script><!-- no <p> --><aside>no</aside><div class="ad">no</div><form>no</form><p hidden>no</p><ul><li>one<li>two</ul></article>
      <section id="comments"><p>{LONG} no</p></section></main><footer>no</footer></body></html>"""
    assert text(page) == "Title\n" + " ".join(LONG.split()) + "\none\ntwo"


def test_pages_without_article():
    assert text(f"<div class=menu>no</div><div class=content><p>{LONG}</p><p>more</p></div>") == " ".join(LONG.split()) + "\nmore"
    assert text("just text") == "just text"
    assert text("") == text("<p>") == text("<!-- never closed") == text("<script>x") == ""
    assert text("a < b <p>c <3 <p title='x>y'>d") == "a < b\nc <3\nd"


def test_an_article_in_several_containers_stays_whole():
    lead, story = " ".join((LONG * 2).split()), " ".join((LONG * 4).split())
    page = f"<body><div class=menu>no</div><div class=page><div class=lead><p>{lead}</p></div><div class=story><p>{story}</p></div><div class=links><a href=x>{LONG}</a></div></div></body>"
    assert text(page).split("\n")[:2] == [lead, story]
    deep = f"<div class=a><div class=b><div class=c><p>{lead}</p></div><p>end</p></div></div><div class=footer>no</div>"
    assert text(deep) == lead + "\nend"
    # an article element is gone on to although something stands outside
    assert text(f"<div>by hand</div><article><div class=x><p>{story}</p></div><div class=y><p>{lead}</p></div></article>") == story + "\n" + lead
    assert Page(f"<div><div class=x><p>{story}</p></div><div class=promo>{lead}</div></div>").text(None) == story


def plain_text(blocks):
    """What a page built from ``blocks`` (kind, words) holds as main text."""
    return "\n".join(words for kind, words in blocks if kind == "text")


def test_generated_pages_against_their_plan():
    r = random.Random(11)
    side = ["<nav>{}</nav>", "<div class='sidebar-2'>{}</div>", "<footer><p>{}</p></footer>", "<div id=cookie-notice>{}</div>", "<aside>{}</aside>", "<form>{}</form>", "<script>{}</script>", "<div class='ad big'>{}</div>", "<section class=comments><p>{}</p></section>", "<div role=navigation>{}</div>", "<div style='display: none'>{}</div>"]
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))
    for n in range(300):
        blocks, html = [], []
        for _ in range(r.randint(0, 12)):
            words = " ".join(word() for _ in range(r.randint(1, 60)))
            if r.random() < 0.4:
                blocks.append(("side", words))
                html.append(r.choice(side).format(words))
            else:
                blocks.append(("text", words))
                shape = r.choice(["<p>{}</p>", "<div class=c{}><p>{{}}</p></div>".format(r.randint(0, 3)), "<h2>{}</h2>", "<section><div>{}</div></section>", "<ul><li>{}</ul>"])
                html.append(shape.format(words.replace(" ", r.choice([" ", "  ", "\n", "&#32;", "<b> </b>"]))))
        page = "".join(html)
        for wrap in ("{}", "<body><div class=wrap><div class='inner x'>{}</div></div><header>no</header></body>", "<main>{}</main>"):
            assert text(wrap.format(page)) == plain_text(blocks), wrap.format(page)


def test_a_very_long_page():
    p = "<p>" + LONG * 50 + "</p>"
    page = "<div class=menu>" + "<a href=x>no</a>" * 20_000 + "</div><div class=story>" + p * 400 + "</div>"
    assert text(page) == "\n".join([" ".join((LONG * 50).split())] * 400)
    assert text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"


def test_host_consensus(spark):
    usual = "<div class='layout'><div class='body-{}'><p>{}</p></div><div class='teaser'><p>{}</p></div></div>"
    rows = [(k, f"http://A.example/{k}", usual.format(k, LONG, "brief " * 8)) for k in range(6)]
    rows += [(7, "http://a.example/x", usual.format(7, "short story", LONG)), (8, None, None), (9, "odd", ""), (7, "http://a.example/x", usual.format(7, "short story", LONG))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    found = main_text.extract(pages)
    assert found.columns == ["page_id", "url", "text"]
    got = sorted(((r.page_id, r.text) for r in found.collect()), key=str)
    want = [(k, " ".join(LONG.split())) for k in range(6)] + [(7, "short story")] * 2 + [(8, ""), (9, "")]
    assert got == sorted(want, key=str)
    assert main_text.extract(pages.limit(0)).count() == 0


def record(body, n):
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{n}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


def test_warc_round_trip(spark):
    big, inner = "x" * 1500, "a" * 30 + record("inner", 77) + record("in two", 78)
    rows = [
        (1, "http://a/b c\r\nX: y", big), (2, None, big), (3, "u", None), (None, "u", ""), (None, "u", big), (4, "u", "WARC/1.1\r\n"), (5, "u", inner),
        (6, "u", record("q", 79)), (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabcWARC/1.1\r\nfoo" + "é" * 700), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n\r\n"),
        (2, "u", big), (9, "u", big + "z"), (10, "u", big + "z"), (12, "u", "y" * 999), (13, "u", "y" * 999), (11, "u", "last WARC/1."),
    ] + [(100 + k, "u", f"p{k}" * (k % 50)) for k in range(40)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, type string").coalesce(2)
    path = scratch.new_folder(spark, "test-warc")
    warc.write(pages, path)
    last, want = {}, []
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    for i, _, h in rows:
        data, end = (h or "").encode(), last.get(h)
        revisit = end is not None and i != end
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", end if revisit else None))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "2000b"):  # records and magics across splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = [tuple(r) for r in warc.pages(spark, path).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    texts = {r.id: r.payload for r in warc.records(spark, path).collect()}
    assert texts["<urn:x-page:5>"] == inner and "<urn:x-page:77>" not in texts
    nothing = scratch.new_folder(spark, "test-warc")
    warc.write(pages.limit(0), nothing)
    assert warc.pages(spark, nothing).count() == 0


def test_broken_archives(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes((record("one", 1) + record("two", 2)).encode() + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut")
    (tmp_path / "b.txt").write_bytes(b"junk" + record("three", 3).encode())
    found = warc.records(spark, str(tmp_path))
    assert sorted((r.at == 0, r.payload) for r in found.collect()) == [(False, "two"), (True, "one")]
