import time

from claimweave.llm.sites import Page, host_of, main_texts


def text(html, template=()):
    return Page(html).main_text(set(template))


def test_blocks_and_markup():
    page = "<html><head><title>T</title></head><body><h1>A  b</h1><p>One <b>two<p>three &amp; four<br>five<ul><li>x<li>y</ul><table><tr><td>1<td>2</table><pre>k\n l</pre>tail<!-- c --> end"
    assert text(page) == "A b\nOne two\nthree & four five\nx\ny\n1\n2\nk l\ntail end"
    assert text("") == "" and text("plain &lt;text&#62; &eacute;") == "plain <text> é"
    assert text("<p>a</p><script>var x='</p><p>no';</script><style>p{}</style><p>b") == "a\nb"
    assert text("<p title=\"a>b\" class='x'>q</p><p>un<closed") == "q\nun"


def test_other_than_main_text_goes():
    page = """<nav>menu</nav><header>site</header><div class="cookie-notice">ok?</div><div id="sidebar">s</div><main><header><h1>Title</h1></header>
    <p>Body</p><div class="ad">buy</div><form><p>mail</p></form><aside>x</aside><p hidden>h</p><section class="comments"><article class="comment"><p>c</p></article></section></main><footer>f</footer>"""
    assert text(page) == "Title\nBody"
    assert text("<div class='header'>site</div><p>Body <span class='additional'>kept</span></p>") == "Body kept"


def test_hosts():
    assert [host_of(u) for u in ("https://A.example.com:80/x", "http://u@b.org", None, "", "not a url", "http://[bad")] == ["a.example.com", "b.org", "", "", "", ""]


def test_template_of_a_site(spark):
    banner, own = "<div><p>Welcome to our site</p><a href='/x'>Start</a></div>", "<div><p>Text number {}</p></div>"
    pages = [(i, f"http://site.org/{i}", f"<body>{banner}{own.format(i)}<p>Same paragraph</p></body>") for i in range(40)]
    pages += [(100 + i, f"http://art.org/{i}", f"<body>{banner}<article><p>Shared by all</p><p>Own {i}</p></article></body>") for i in range(8)]
    pages += [(200, "http://one.org/", f"<body>{banner}<p>Alone</p></body>"), (201, None, None), (202, "http://one.org/", ""), (None, "http://one.org/", "<p>x</p>"), pages[0]]
    df = spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id bigint, url string, html string, text int, host int")
    got = sorted((str(r.page_id), r.text) for r in main_texts(df).collect())
    want = [(str(i), f"Text number {i}") for i in [*range(40), 0]] + [(str(100 + i), f"Shared by all\nOwn {i}") for i in range(8)]
    want += [("200", "Welcome to our site\nStart\nAlone"), ("201", ""), ("202", ""), ("None", "x")]
    assert got == sorted(want)
    assert main_texts(df.limit(0)).count() == 0


def test_long_and_deep_pages():
    assert len(text("<div>" * 3000 + "x" + "<p>y " * 3000)) > 3000
    assert text("<p>" + "word " * 200_000).count("word") == 200_000


def test_copies_of_a_wrapped_article_stay_whole(spark):
    banner = "<div><p>Welcome to our site</p></div>"
    copy = f"<body><div id=page>{banner}<div id=content><article><p>Copied text</p></article></div></div></body>"
    pages = [(i, f"http://site.org/{i}", copy) for i in range(6)] + [(10 + i, f"http://site.org/o{i}", copy.replace("Copied", f"Own {i}")) for i in range(6)]
    got = sorted((r.page_id, r.text) for r in main_texts(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect())
    assert got == [(i, "Copied text") for i in range(6)] + [(10 + i, f"Own {i} text") for i in range(6)]


def test_ordinary_markup_keeps_its_text():
    for page, want in (
        ("<article><div style='overflow:hidden'><p>Body text.</p></div></article>", "Body text."),
        ('<article><p>See <a title="A hidden gem">the shop</a> now</p></article>', "See the shop now"),
        ('<body class="has-sidebar"><article><p>Text</p></article></body>', "Text"),
        ('<body class="single no-comments"><p>Text</p></body>', "Text"),
        ('<article><h2 id="social-policy">Policy</h2><section id="related-work"><p class="widget-intro">Work</p></section></article>', "Policy\nWork"),
        ('<div class="menu-wrapper"><article><p>Inside a wrapper</p></article></div>', "Inside a wrapper"),
        ("<article><p>One</p></article><p>Two stands outside</p>", "One\nTwo stands outside"),
        ('<p data-x="class=ad">A</p><p id=b class="x y">B</p><p aria-hidden=false>C</p><p aria-hidden="true">D</p><p hidden>E</p>', "A\nB\nC"),
        ('<article><p>A long enough text</p></article><section class="comments"><article><p>says who</p></article></section>', "A long enough text"),
        ('<article><div class="comments"><p>c</p></div><div class="ad">x</div><p>T</p></article>', "T"),
    ):
        assert text(page) == want, page


def test_recurring_blocks_inside_articles_against_brute_force(spark):
    """A notice without a telling name goes from every article of a host; shared paragraphs and copied articles stay."""
    notice, box = "<div class='x1'><p>Dear readers, we moved.</p></div>", "<section><p>Read on every day</p></section>"
    own = lambda i: f"<p>Story {i} " + f"goes on and on {i} " * 30 + "</p>"
    pages = [(i, f"http://a.org/{i}", f"<article><h1>T {i}</h1>{notice}{own(i)}<p>Shared words</p>{box if i < 4 else ''}</article><div>Start here</div>") for i in range(9)]
    pages += [(20 + i, f"http://b.org/{i}", f"<article><h1>Copy</h1>{notice}{own(0)}</article>") for i in range(9)]  # copies count as one page
    pages += [(40, "http://c.org/", pages[0][2]), (41, None, pages[0][2])]

    def template(host):
        found = {}
        for _, url, html in pages:
            if host_of(url) == host:
                hashes, main = Page(html).subtrees()
                for h in hashes:
                    found.setdefault(h, set()).add(main)
        return {h for h, mains in found.items() if len(mains) >= 5}

    got = sorted(tuple(r) for r in main_texts(spark.createDataFrame(pages, "page_id bigint, url string, html string")).select("page_id", "text").collect())
    assert got == sorted((i, Page(h).main_text(template(host_of(u)))) for i, u, h in pages)
    texts = dict(got)
    assert texts[0] == f"T 0\nStory 0 {('goes on and on 0 ' * 30).strip()}\nShared words\nRead on every day"
    assert "Dear readers" not in texts[8] and "Dear readers" in texts[20] and "Dear readers" in texts[40] and "Start here" in texts[40]


def test_unmatched_end_tags_are_cheap():
    start = time.perf_counter()
    n = 60_000
    assert text("<b>" * n + "x" + "</i>" * n) == "x"
    assert text("<i><table>" + "<b>" * n + "y" + "</i>" * n) == "y"
    assert time.perf_counter() - start < 20


def test_pages_that_are_not_read_by_the_size_of_the_host(spark):
    """The same block on five pages goes on a small host and on a large one."""
    block = "<div><p>Spring fair in town</p></div>"
    page = lambda i: f"<body>{block if i < 5 else ''}<div><p>Text number {i}</p></div></body>"
    for n in (6, 400):
        df = spark.createDataFrame([(i, f"http://h.org/{i}", page(i)) for i in range(n)], "page_id bigint, url string, html string")
        assert sorted(r.text for r in main_texts(df).collect()) == sorted(f"Text number {i}" for i in range(n))
