from linework.llm import html_text
from linework.llm.html_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="ad">Buy now, a long and winding advert text
that goes on and on for many words so that its ratio is high.</div>
<header><h2>Site</h2></header><div id="cookie-notice">We use cookies</div>
<article><header><h1>Title &amp; more</h1></header><p><b>First   par&shy;agraph &lt;here&gt;
with a break.<br>And more.<p>Short.</p><aside>Related things</aside><div class="comments"><p>I disagree</p></div>
<form><input name=x>Search</form></article><footer>&copy; me</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title & more\nFirst par­agraph <here> with a break. And more.\nShort."


def test_without_article():
    long = "This is a sentence of the main text that goes on for a while. " * 5
    page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><div><p>{long}</p><p>{long}</p></div><div class=footer>x</div></body>"
    assert main_text(page) == "\n".join([long.strip()] * 2)
    page = f"<body><div>top</div><div id=content><h2>Head</h2><p>{long}</p><p>Short.</p><p>{long}</p><p>End.</p></div><div>bottom</div></body>"
    assert main_text(page).split("\n") == ["Head", long.strip(), "Short.", long.strip(), "End."]
    page = f"<body>Logo<p>{long}</p><p>Short.</p><p>{long}</p></body>"
    assert "Short." in main_text(page)


def test_broken_and_empty():
    assert main_text("") == ""
    assert main_text("<article></article>") == ""
    assert main_text("<article>a &am") == "a &am"
    assert main_text("<nav><ul><li>menu<article><p>text<p>more") == "text\nmore"
    assert main_text("<article><p>a</b></i></div>b</p></article>") == "ab"  # stray end tags are ignored
    assert main_text("plain text only") == "plain text only"
    assert len(main_text("<article>" + "<div>" * 3000 + "x" + "</div>" * 3000)) == 1


def test_chunks_do_not_matter(monkeypatch):
    whole = main_text(PAGE)
    for n in (1, 7, 100):
        monkeypatch.setattr(html_text, "CHUNK", n)
        assert main_text(PAGE) == whole


def test_smoothing_keeps_the_mean():
    import numpy as np

    assert np.allclose(html_text.smoothed(np.full(9, 3.0)), 3.0)


def test_spark(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == 4
    assert all(r.n_chars == len(r.text) for r in got)
    assert sum(r.text == main_text(PAGE) for r in got) == 2
    assert html_text.extract(pages.limit(0)).count() == 0


def test_wrappers_with_signs():
    long = "This is a sentence of the main text that goes on for a while. " * 5
    for attrs in ('class="layout has-sidebar"', 'id="page" class="nav-open"', 'class="search-results"', 'class="search"', 'class="header"', 'class="no-comments"'):
        for tag in ("div", "section"):
            for inner in ("article", "main", "div"):
                page = f"<body><nav>menu</nav><{tag} {attrs}><{inner}><p>{long}</p><p>Short.</p><p>{long}</p></{inner}></{tag}><div class=footer>foot</div></body>"
                assert main_text(page) == "\n".join([long.strip(), "Short.", long.strip()]), (tag, attrs, inner)


def test_parts_of_an_article_with_signs():
    long = "This is a sentence of the main text that goes on for a while. " * 5
    page = f"""<article><div class="post-header"><h1>Head</h1></div><p>{long}</p><p class="notice">Mind this.</p><div class="related-work">Work.</div>
        <div class="site-footer">foot</div><div id="share-buttons">Share</div><div class="sidebar left">side</div></article>
        <div class="comments"><article>{long * 3}</article></div><div class="related"><article>Teaser</article></div>"""
    assert main_text(page) == "\n".join(["Head", long.strip(), "Mind this.", "Work."])


LONG = "This is a sentence of the main text that goes on for a while. " * 4
UNSIGNED = "<body><div>" + "<div><b>tag</b> <i>w</i> <b>x</b></div>" * 120 + f"</div><{{0}}><p>{LONG}</p><p>Short.</p><p>{LONG}</p></{{0}}><div>" + "<div><i>end</i> <b>y</b></div>" * 60 + "</div></body>"


def test_ratios_choose_the_region(monkeypatch):
    import numpy as np

    for tag in ("div", "article"):
        want = "\n".join([LONG.strip(), "Short.", LONG.strip()])
        assert main_text(UNSIGNED.format(tag)) == want
    with monkeypatch.context() as m:
        m.setattr(html_text, "smoothed", lambda ratios, width=1.0: np.full(len(ratios), 5.0))
        for tag in ("div", "article"):
            assert main_text(UNSIGNED.format(tag)) != want


def test_clusters_against_brute_force():
    import math
    import random

    rng = random.Random(7)
    for _ in range(200):
        lines = [html_text.Line("x" * rng.choice([1, 5, 40, 200]), rng.randrange(5), rng.choice([0, 0, 0, 100]), rng.random() < 0.8, rng.choice([-1, 0]), 0, 0, -1) for _ in range(rng.randrange(1, 30))]
        ratios = [len(x.text) / max(1, x.tags) if x.fit else 0.0 for x in lines]
        smooth = []
        for i in range(len(lines)):
            w = [math.exp(-d * d / 2) for d in range(-3, 4)]
            near = [ratios[min(max(i + d, 0), len(lines) - 1)] for d in range(-3, 4)]
            smooth.append(sum(a * b for a, b in zip(w, near)) / sum(w))
        mean = sum(smooth) / len(smooth)
        spread = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth)) if len(lines) > 2 else 0.0
        want = [x.fit and s > 0 and s >= min(mean, spread) - 1e-12 and (x.region >= 0 or 2 * x.linked <= len(x.text)) for x, s in zip(lines, smooth)]
        assert html_text.clusters(lines).tolist() == (want if any(want) else [x.fit for x in lines])


def test_deep_and_long_pages_take_linear_time():
    import time

    n = 100_000
    for page in ("<div>word" * n, "<p><button>" + "<div>" * n + "x", "<article>" + "<div class=ad><p>word" * n, "<b>" * n + "x<p>y</p>" * n, "<ul>" + "<li>a" * n):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 12  # quadratic would take hours


def test_short_article_beside_longer_boilerplate():
    page = f"<body><nav><a href=1>one</a></nav><div class=ad>{LONG}</div><article><h1>Tiny</h1><p>Er.</p></article><footer>{LONG}</footer></body>"
    assert main_text(page) == "Tiny\nEr."


def test_comments_and_adverts_by_other_names():
    page = lambda b: main_text(f"<body><nav>menu</nav>{b}</body>")
    for part in ('<div class="comment-thread"><p>I say</p></div>', '<div id="user-comments">I say</div>', '<section class="discussion">I say</section>', '<div class="google-ad">Buy</div>', '<div class="topSponsored sponsored-posts">Buy</div>'):
        assert page(f"<article><p>The text.</p>{part}<p>More.</p></article>") == "The text.\nMore.", part
    assert page(f'<main><p>{LONG}</p><article class="comment">I say</article><article>Another part.</article></main>') == f"{LONG.strip()}\nAnother part."
    assert page('<article><p class="ad-hoc">One.</p><p class="no-comments">Two.</p></article>') == "One.\nTwo."


def test_inline_elements_end_no_line():
    page = lambda b: main_text(f"<body><article><p>{b}</p><p>z</p></article></body>")
    assert page("one <svg><text>s</text></svg> two") == "one two\nz"
    assert page('one <span class="share">x <b>y</b></span> two') == "one two\nz"
    assert page("x <button><div>b</div></button> y") == "x y\nz"
    assert page("foo<script>var t='</p>';</script>bar") == "foobar\nz"
    assert page("x <noscript><div>n</div></noscript> y") == "x y\nz"
    assert main_text("<body><a class='banner'><article><p>kept</p></article></a></body>") == "kept"


def test_comment_that_is_never_closed():
    assert main_text("<article><p>text</p><!-- never " + "<p>x</p>" * 1000) == "text"
