import json
import random
import time

from foliolens.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string"


def page(rng, host, i, close=True):
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    title, parts = prose(4), [prose(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 6))]
    body = f"<h1>{title}</h1><p><b>{parts[0]} &amp; x<br>" + "".join(f"<p>{p}</p>\n " for p in parts[1:])
    html = (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">{word()}</a></li></ul></nav>'
        f'<!-- ad --><div class="ad">{prose(8)}</div><article>{body}<div class="x9">Welcome to {host}</div><div class="comments"><p>{prose(50)}</p></div></article>'
        f"<footer>&copy; {host} {prose(6)}</footer>" + ("</body></html>" if close else "")
    )
    return html, "\n\n".join([title, f"{parts[0]} & x", *parts[1:]])


def test_extraction(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for i in range(60):
        host = f"h{i % 3}.example"
        html, text = page(rng, host, i, i % 5 > 0)
        rows.append((i, f"https://user@{host}:80/{i}", html, "x"))
        expected[i] = text
    rows += [(100, None, None, "x"), (101, "http://one.example/", "", "x"), (102, "http://one.example/a", "<p>only &lt;text&gt;  here\n now", "x"), (None, "::", "<script>x", None), (103, "http://q/", "a < b and <p cl", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["page_id"]: r for r in H.main_text(df).collect()}
    assert len(got) == 65
    for i, text in expected.items():
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text), i
    assert [got[k]["text"] for k in (100, 101, 102, None, 103)] == ["", "", "only <text> here now", "", "a < b and"]
    assert H.main_text(df.limit(0)).collect() == []


def test_tree_match():
    a, b = H.parse("<div><p>x</p><ul><li>1</li></ul><p>y</p></div>"), H.parse("<div><p>x</p><p>z</p></div>")
    n, pairs = H.tree_match(a, b)
    assert n == 4 and [(x.own_text(), y.own_text()) for x, y in pairs if x.tag == "p"] == [("y", "z"), ("x", "x")]


def test_copies_do_not_make_template():
    html = "<body><div><p>the same article text on every page of this host</p></div></body>"
    assert H.extract(html, H.induce([html] * 6)) == "the same article text on every page of this host"


def test_deep_and_long():
    assert H.extract("<div>" * 3000 + "<p>deep</p>", None) == "deep"
    assert len(H.extract("<p>word " * 20000, None)) == 20000 * 4 + 19999 * 2


def test_all_prose_of_mixed_pages(spark):
    """Pages with two articles, or with prose beside the article, among pages with one, lose nothing."""
    body = lambda i: f"<article><p>first prose number {i} of the page</p></article>"
    rows = [(i, f"http://m/{i}", f"<html><body>{body(i)}</body></html>", "x") for i in range(20)]
    rows += [(100, "http://m/a", f"<html><body>{body(100)}<article><p>second prose</p></article></body></html>", "x")]
    rows += [(101, "http://m/b", f"<html><body>{body(101)}<section><p>prose beside</p></section></body></html>", "x")]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "first prose number 3 of the page"
    assert got[100] == "first prose number 100 of the page\n\nsecond prose"
    assert got[101] == "first prose number 101 of the page\n\nprose beside"


def test_template_of_hosts_with_odd_pages_and_layouts(spark):
    """Template text counts though some pages of the host lack it, and though half of them have another layout."""
    rows, odd = [], {3, 9, 14, 22, 27, 33}
    for i in range(40):
        rows.append((i, f"http://odd/{i}", f"<body><div><p>prose {i}</p>" + ("" if i in odd else "<p>Read more on our site</p>") + "</div></body>", "x"))
        name, text = ("a", "Layout A says so") if i % 2 else ("b", "Layout B says so")
        rows.append((100 + i, f"http://two/{i}", f'<body><div><p>{text}</p><p>prose {i}</p></div><hr class="{name}"></body>', "x"))
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == got[100 + i] == f"prose {i}" for i in range(40))


def test_classes_keep_the_article_and_its_headline():
    prose = "<p>prose of the article itself</p>"
    assert H.extract(f'<body><div class="page has-sidebar"><article>{prose}</article><div class="sidebar">aside</div></div></body>', None) == "prose of the article itself"
    assert H.extract(f'<body><article><div class="content-header"><h1>T</h1></div>{prose}</article></body>', None) == "T\n\nprose of the article itself"
    assert H.extract(f'<body><header><h1>Site</h1></header><article><header><h1>T</h1></header>{prose}</article></body>', None) == "T\n\nprose of the article itself"
    assert H.extract(f"<body><form><main>{prose}</main><button>Go</button></form></body>", None) == "prose of the article itself"
    assert H.extract(f'<body><div class="notice">{prose}</div></body>', None) == "prose of the article itself"
    assert H.extract(f'<body><article>{prose}<div class="notice">We moved</div><section class="comments"><p>me too</p></section></article></body>', None) == "prose of the article itself"


def test_odd_quotes_and_stray_marks():
    assert H.extract('<p title="it>foo</p><p>bar', None) == "foo\n\nbar"
    assert H.extract("<p>a </ b <3 </p>c <> d", None) == "a </ b <3\n\nc <> d"
    assert H.extract("<p a='x>y'>z<p b=\"<q>\">w", None) == "z\n\nw"


def test_time_grows_with_length_only():
    began = time.process_time()
    assert H.extract("<div>" * 50_000 + "<p>deep</p>", H.induce(["<div>" * 50_000 + f"<p>{i}" for i in range(5)])) == "deep"
    assert H.extract("<p>" + "<b>" * 50_000 + "x" + "<div>" * 5 + "</i>" * 50_000, None)
    assert H.extract('<a title="' * 20_000, None) == ""
    assert time.process_time() - began < 12


def matched(a, b):
    """Simple tree matching as defined, without tables."""
    if a[0] != b[0]:
        return 0

    def rows(x, y):
        if not x or not y:
            return 0
        return max(rows(x[:-1], y), rows(x, y[:-1]), rows(x[:-1], y[:-1]) + matched(x[-1], y[-1]))

    return 1 + rows(a[1], b[1])


def test_tree_match_equals_brute_force():
    rng = random.Random(4)

    def tree(n):
        made = []
        while n > 0:
            size = rng.randrange(1, n + 1)
            made.append((rng.choice(["div", "section", "article"]), tree(size - 1)))
            n -= size
        return made

    html = lambda nodes: "".join(f"<{t}>{html(c)}</{t}>" for t, c in nodes)
    for _ in range(200):
        a, b = tree(rng.randrange(8)), tree(rng.randrange(8))
        n, pairs = H.tree_match(H.parse(html(a)), H.parse(html(b)))
        assert n == len(pairs) == matched(("", a), ("", b))
        assert all(x.name == y.name for x, y in pairs)


def test_linked_articles():
    """Text that is all linked is text."""
    assert H.extract("<body><nav><a>menu</a></nav><article><p><a>All linked sentence.</a></p><p><a>And more.</a></p></article><footer>f</footer></body>", None) == "All linked sentence.\n\nAnd more."
    assert H.extract('<body><div class="cookie-notice"><p>We use cookies</p></div><main><p><a>All linked.</a></p></main></body>', None) == "All linked."
    assert H.extract("<body><ul><li><a>One</a></li><li><a>Two</a></li></ul><nav><a>menu</a></nav></body>", None) == "One\n\nTwo"
    assert H.extract("<body><nav><a>menu</a></nav></body>", None) == ""


def test_classes_mark_by_their_whole_names():
    article = "<body><article><p>First of the article.</p>{}</article></body>"
    kept = ['<div class="share-price"><p>Share price rose.</p></div>', '<section class="related work"><p>Earlier studies say so.</p></section>', '<div class="post-alert-study"><p>The study went on.</p></div>', '<div class="header-file"><p>Declared there.</p></div>']
    for inner in kept:
        text = inner.split("<p>")[1].split("</p>")[0]
        assert H.extract(article.format(inner), None) == "First of the article.\n\n" + text, inner
    gone = ["cookie-notice", "site-header", "ad", "adSlot", "ad-slot-2", "comments", "comment-list", "sidebar-left", "js-newsletter-signup", "notice", "social-share"]
    for name in gone:
        assert H.extract(article.format(f'<div class="{name}"><p><a>Not of the article.</a></p></div>'), None) == "First of the article.", name
    assert H.extract(article.format('<div class="related"><ul><li><a>Another story</a></li></ul></div>'), None) == "First of the article."


def test_headings_that_articles_share(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for i in range(8):
        prose = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) + f" {i}" for _ in range(4)]
        html = f"<body><article><h1>Title {i}</h1><h2>Summary</h2><p>{prose[0]}</p><h2>Details</h2><h3>Method</h3><p>{prose[1]}</p><p>{prose[2]}</p><h2>Follow us</h2><p>On all channels</p><h2>Conclusion</h2><p>{prose[3]}</p><h3>Read next</h3></article></body>"
        rows.append((i, f"http://shared/{i}", html, "x"))
        expected[i] = f"Title {i}\n\nSummary\n\n{prose[0]}\n\nDetails\n\nMethod\n\n{prose[1]}\n\n{prose[2]}\n\nConclusion\n\n{prose[3]}"
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected


def test_time_of_large_tables():
    rng = random.Random(5)

    def table(rows, cells, odd):
        row = lambda: "".join(f"<td>{'<b>x</b>' if rng.random() < odd else 'x'}</td>" for _ in range(cells))
        return H.parse("<table>" + "".join(f"<tr>{row()}</tr>" for _ in range(rows)) + "</table>")

    for rows, cells, odd in ((200, 100, 0.0), (200, 100, 0.01), (100, 30, 0.5), (300, 12, 0.3)):
        a, b = table(rows, cells, odd), table(rows, cells, odd)
        began = time.process_time()
        n, pairs = H.tree_match(a, b)
        assert time.process_time() - began < 4 and n == len(pairs) >= rows * cells * 0.8


def test_wrappers_are_learned_from_all_pages(spark):
    """What only some pages of a host share, and where most of its pages keep their prose, is counted over all of them, whichever six would be drawn."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    made = [f"<div class='{'new' if i >= 100 else 'old'}'><h1>{prose(3)}</h1><p>{'On sale now' if i < 100 else prose(3)}</p><p>{prose(20)}</p></div><div class='end'>The same end</div>" for i in range(260)]
    hashed = spark.range(100_000).selectExpr("id", "xxhash64(id) AS h").orderBy("h").limit(260).collect()
    # The hundred pages with the smallest hashes are those of the old kind.
    rows = [(r["id"], "http://one.example/a", made[i]) for i, r in enumerate(hashed)]
    wrapper = json.loads(H.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string")).first()["wrapper"])
    plain = H.induce(made)
    assert wrapper["content"] == plain["content"] == next(n.key for n in H._walk(H.parse(made[-1])) if n.name == "div.new")
    assert set(plain["constant"]) <= set(wrapper["constant"])
    odd = next(n for n in H._walk(H.parse(made[0])) if n.own_text() == "On sale now")
    sampled = H.induce(made[:6])
    assert H._hash("On sale now", odd.key) in sampled["constant"] and sampled["content"] != plain["content"]
