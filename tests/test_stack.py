"""What needs a stack of open elements, against plain versions that look at all pairs, on random markup."""

import random
import re
import time

from foliolens.functions import text as T
from foliolens.operators import corpora, pages, sections

TAGS = ["div", "p", "h2", "b", "ul", "li", "nav", "article", "br", "td", "span"]
VOID = {"br"}


def random_html(rng):
    parts = []
    for _ in range(rng.randrange(0, 40)):
        kind = rng.random()
        tag = rng.choice(TAGS)
        parts.append(f"<{tag}>" if kind < 0.4 else f"</{tag}>" if kind < 0.7 else f"<{tag}/>" if kind < 0.72 else rng.choice(["x", " y ", "&amp;", "a b"]))
    return "".join(parts)


def parse(html):
    """(tokens, elements): tokens (kind, tag, text, own element), elements [tag, parent, open, close]."""
    tokens, elements, stack, pos = [], [], [], -1
    for raw in re.findall(r"</?[a-z0-9]+/?>|[^<]+", html):
        pos += 1
        tag = re.sub(r"[</>]", "", raw)
        if not raw.startswith("<"):
            tokens.append(("text", None, raw, stack[-1] if stack else None))
        elif raw.startswith("</"):
            own = None
            if any(elements[i][0] == tag for i in stack):
                while True:
                    i = stack.pop()
                    elements[i][3] = pos
                    if elements[i][0] == tag:
                        own = i
                        break
            tokens.append(("close", tag, None, own))
        else:
            elements.append([tag, stack[-1] if stack else None, pos, pos])
            tokens.append(("open", tag, None, len(elements) - 1))
            if tag not in VOID and not raw.endswith("/>"):
                stack.append(len(elements) - 1)
    for i in stack:
        elements[i][3] = pos
    return tokens, elements


def path(elements, i):
    out = []
    while i is not None:
        out.append(i)
        i = elements[i][1]
    return out[::-1]


def htmls(seed, n=120):
    rng = random.Random(seed)
    return [random_html(rng) for _ in range(n)]


def tokenized(spark, texts):
    return pages.tokenize(spark.createDataFrame(list(enumerate(texts)), "page_id int, html string"), "page_id")


def test_elements(spark):
    texts = htmls(1)
    got = {(r["page_id"], r["el"]): (r["tag"], r["parent"], r["open_pos"], r["close_pos"], r["depth"], r["path"]) for r in pages.elements(tokenized(spark, texts), "page_id").collect()}
    expected = {}
    for i, html in enumerate(texts):
        _, elements = parse(html)
        for el, (tag, parent, opened, closed) in enumerate(elements):
            above = path(elements, el)[:-1]
            expected[i, el] = (tag, parent, opened, closed, len(above), [elements[a][0] for a in above])
    assert got == expected


def outermost(elements, el, tags):
    return next((i for i in path(elements, el) if elements[i][0] in tags), None)


def test_text_blocks_and_section_text(spark):
    texts = htmls(2)
    tokens = tokenized(spark, texts)
    blocks = pages.text_blocks(tokens, "page_id")
    got = {(r["page_id"], r["el"]): (r["tag"], r["text"]) for r in blocks.collect()}
    expected, sections_text = {}, {}
    for i, html in enumerate(texts):
        tokens_, elements = parse(html)
        held = {}
        for kind, _, text, el in tokens_:
            block = outermost(elements, el, pages.BLOCKS) if el is not None else None
            if kind == "text" and block is not None:
                held.setdefault(block, []).append(text)
        said = {b: " ".join("".join(t).replace("&amp;", "&").split()) for b, t in held.items()}
        expected |= {(i, b): (elements[b][0], t) for b, t in said.items()}
        if any(said.values()):
            sections_text[i] = "\n\n".join(said[b] for b in sorted(said) if said[b])
    assert got == expected
    assert {r["page_id"]: r["text"] for r in pages.section_text(blocks, "page_id").collect()} == sections_text


def test_chrome_and_main_content(spark):
    texts = htmls(3)
    tokens = tokenized(spark, texts)
    stripped = {r["page_id"]: r["html"] for r in pages.serialize(pages.strip_chrome(tokens, "page_id", ("nav", "ul")), "page_id").collect()}
    main = {r["page_id"]: (r["container"], r["n_chrome"], r["html"]) for r in pages.main_content(tokens, "page_id", ("article", "div"), ("nav", "ul")).collect()}
    for i, html in enumerate(texts):
        tokens_, elements = parse(html)
        raws = re.findall(r"</?[a-z0-9]+/?>|[^<]+", html)
        # A close tag that ends nothing lies in the element that is open around it.
        around = [own if own is not None else next((e for e in range(len(elements) - 1, -1, -1) if elements[e][2] < at <= elements[e][3] and elements[e][0] not in VOID and elements[e][3] > elements[e][2]), None) for at, (_, _, _, own) in enumerate(tokens_)]
        shown = [r for r, el in zip(raws, around, strict=True) if el is None or outermost(elements, el, ("nav", "ul")) is None]
        assert stripped.get(i, "") == "".join(shown)
        found = None
        for tag in ("article", "div"):
            firsts = [e for e in range(len(elements)) if elements[e][0] == tag and outermost(elements, e, (tag,)) == e]
            if firsts:
                found = (tag, min(firsts))
                break
        if found is None:
            assert i not in main
            continue
        inside = [(r, el) for r, (_, _, _, el) in zip(raws, tokens_, strict=True) if el is not None and outermost(elements, el, (found[0],)) == found[1]]
        chrome = {outermost(elements, el, ("nav", "ul")) for _, el in inside} - {None}
        assert main[i] == (found[0], len(chrome), "".join(r for r, el in inside if outermost(elements, el, ("nav", "ul")) is None))


def test_preceding_reference(spark):
    texts = htmls(4, 200)
    got = {(r["page_id"], r["el"]): r["reference"] for r in pages.preceding_reference(tokenized(spark, texts), "page_id", ("br",)).collect()}
    expected = {}
    for i, html in enumerate(texts):
        tokens_, elements = parse(html)
        explicit = {own for kind, _, _, own in tokens_ if kind == "close"}
        for el, (tag, parent, opened, _) in enumerate(elements):
            above = [None, *path(elements, parent)] if parent is not None else [None]
            near = None
            for holder in reversed(above):
                # Siblings that their own close tag ended, or that end with something around them, before the target opens.
                before = [s for s, (t, p, o, c) in enumerate(elements) if p == holder and t in pages.REFERENCES and c < opened and s in explicit]
                if before:
                    near = max(before, key=lambda s: elements[s][3])
                    break
            if tag != "br" or near is None:
                continue
            texts_ = [t for kind, _, t, own in tokens_ if kind == "text" and own is not None and outermost(elements, own, pages.REFERENCES) == near]
            if texts_:
                expected[i, el] = " ".join("".join(texts_).replace("&amp;", "&").split())
    assert got == expected


def test_deep_pages_take_time_by_their_length(spark):
    html = "<div>" * 30_000 + "x" + "</i>" * 30_000 + "<p>deep</p>"
    began = time.time()
    assert [r["text"] for r in pages.text_blocks(tokenized(spark, [html]), "page_id").collect()] == ["deep"]
    assert len(sections.text_runs(tokenized(spark, [html]), "page_id").collect()) == 2
    assert time.time() - began < 60


def test_proper_nouns_equal_plain_count(spark):
    rng = random.Random(5)
    names = ["Ada", "Ada Lovelace", "Grace Hopper", "Hopper", "River", "Big River Bank", "Then Golgi", "The"]
    docs = [" ".join(rng.choice([*names, "went.", "and", "saw", "it!", "the"]) for _ in range(rng.randrange(80))) for _ in range(30)]
    got = {(r["k"], r["name"]): (r["total"], r["mid"]) for r in corpora.proper_nouns(spark.createDataFrame(list(enumerate(docs)), "k int, text string"), "k").collect()}
    expected = {}
    for k, doc in enumerate(docs):
        counts = {}
        for sentence in re.split(r"(?<=[.!?])\s+|\n", doc):
            for m in re.finditer(r"[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}", sentence):
                name, words = m.group(), m.group().split(" ")
                if m.start() == 0 and len(words) > 1 and words[0] in corpora.OPENERS:
                    name = " ".join(words[1:])
                total, mid = counts.get(name, (0, 0))
                counts[name] = (total + 1, mid + (m.start() > 0 or len(words) > 1))
        kept = {n: c for n, c in counts.items() if c[0] >= 2 and c[1] >= 1}
        expected |= {(k, n): c for n, c in kept.items() if not any(n != o and f" {n} " in f" {o} " for o in kept)}
    assert got == expected


def test_glyphs_and_first_sentences(spark):
    docs = ["a¤b c¤d e¤f a¤b x§y", "a¤b a¤b a¤b", "no intruder: it's a-b c.d"]
    assert [tuple(r) for r in corpora.glyph_corruption(spark.createDataFrame(list(enumerate(docs)), "k int, t string"), "k", "t").collect()] == [(0, "¤", 3)]
    texts = ["Short. But this goes on and on. Then more.", "See Mr. Jones about the matter at hand, etc. Then go.", "no end", "What a very long day it was for us! (Yes.)"]
    got = [r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.first_sentence("t").alias("s")).orderBy("k").collect()]
    assert got == ["Short. But this goes on and on.", "See Mr. Jones about the matter at hand, etc. Then go.", "no end", "What a very long day it was for us!"]


def test_budget_of_the_frontier(spark):
    seeds = spark.createDataFrame([("a", "s"), ("b", "t")], "chapter string, url string")
    links = spark.createDataFrame([("s", f"p{i}") for i in range(9)] + [(f"p{i}", f"q{i}") for i in range(9)] + [("q1", "s"), ("t", "u")], "src string, dst string")
    got = sorted(tuple(r) for r in corpora.expand_frontier(seeds, links, budget=4).collect())
    assert got == [("a", "p0", 1), ("a", "p1", 1), ("a", "p2", 1), ("a", "s", 0), ("b", "t", 0), ("b", "u", 1)]
    assert len(corpora.expand_frontier(seeds, links, budget=None).collect()) == 21


def test_trees_of_any_depth(spark):
    nodes = spark.createDataFrame([("b", str(i), None if i == 0 else str(i - 1), 0) for i in range(15)], "book string, node string, parent string, ord long")
    assert sorted(r["depth"] for r in corpora.flatten_tree(nodes).collect()) == list(range(15))


def random_marked_html(rng):
    """Markup with ids, classes and attributes."""
    parts = []
    for _ in range(rng.randrange(0, 40)):
        tag = rng.choice(["div", "p", "nav", "span", "li"])
        attrs = "".join(f' {n}="{rng.choice(v)}"' for n, v in (("id", ["toc", "x"]), ("class", ["a", "b", "a b", "ab"]), ("data-k", ["1", "2", "3 4"])) if rng.random() < 0.4)
        parts.append(f"<{tag}{attrs}>" if rng.random() < 0.45 else f"</{tag}>" if rng.random() < 0.6 else "t")
    return "".join(parts)


SELECTORS = ("nav#toc", ".a.b", "div .a span", "[data-k='3 4'], li[id]", "p p", "div [data-k=1] *", "nav")


def test_selectors_on_tokens(spark):
    """Each selector against a plain reading of it: all chains of ancestors are tried."""
    from itertools import combinations

    rng = random.Random(12)
    texts = [random_marked_html(rng) for _ in range(150)]
    tests = {
        "nav#toc": [lambda t, a: t == "nav" and a.get("id") == "toc"], ".a.b": [lambda t, a: {"a", "b"} <= set(a.get("class", "").split())], "p p": [lambda t, a: t == "p"] * 2, "nav": [lambda t, a: t == "nav"],
        "div .a span": [lambda t, a: t == "div", lambda t, a: "a" in a.get("class", "").split(), lambda t, a: t == "span"], "div [data-k=1] *": [lambda t, a: t == "div", lambda t, a: a.get("data-k") == "1", lambda t, a: True],
    }
    fits = lambda chain, test: len(chain) >= len(test) and test[-1](*chain[-1]) and any(all(t(*chain[i]) for t, i in zip(test, at, strict=False)) for at in combinations(range(len(chain) - 1), len(test) - 1))
    counts, kept, nested = {}, {}, 0
    for i, html in enumerate(texts):
        stack, out = [], []
        for raw in re.findall(r"<[^>]+>|[^<]+", html):
            hidden = any(h for _, _, h in stack)
            if raw.startswith("</"):
                tag = raw[2:-1]
                own = [k for k, (t, _, _) in enumerate(stack) if t == tag]
                if own:
                    hidden = any(h for _, _, h in stack[: own[-1] + 1])
                    del stack[own[-1] :]
            elif raw.startswith("<"):
                tag, attrs = re.match(r"<(\w+)", raw)[1], dict(re.findall(r' ([\w-]+)="([^"]*)"', raw))
                chain = [(t, a) for t, a, _ in stack] + [(tag, attrs)]
                found = [s for s in SELECTORS if (fits(chain, tests[s]) if s in tests else attrs.get("data-k") == "3 4" or tag == "li" and "id" in attrs)]
                if found and not hidden:
                    counts[i, found[0]] = counts.get((i, found[0]), 0) + 1
                nested += bool(found) and hidden
                hidden = hidden or bool(found)
                stack.append((tag, attrs, bool(found)))
            if not hidden:
                out.append(raw)
        kept[i] = "".join(out)
    tokens = tokenized(spark, texts)
    assert {(r["page_id"], r["selector"]): r["n"] for r in pages.chrome_counts(tokens, "page_id", SELECTORS).collect()} == counts and nested > 20 and len({s for _, s in counts}) == len(SELECTORS)
    got = {r["page_id"]: r["html"] for r in pages.serialize(pages.strip_chrome(tokens, "page_id", SELECTORS), "page_id").collect()}
    assert got == {i: h for i, h in kept.items() if h}


def test_book_content(spark):
    html = '<body><div class="entry-content x"><p>a</p><div class="noindex">b</div><nav>c</nav></div><main>d</main></body>'
    rows = pages.main_content(tokenized(spark, [html, "<body><header>x</header>y</body>"]), "page_id", pages.BOOK_CONTAINERS, pages.BOOK_CHROME).collect()
    assert {r["page_id"]: (r["n_chrome"], r["html"]) for r in rows} == {0: (2, '<div class="entry-content x"><p>a</p></div>'), 1: (1, "<body>y</body>")}


def test_metadata_in_one_pass(spark):
    """All kinds of metadata come of one pass over the tokens: one Python node, where there was one a kind."""
    html = '<h2>A</h2><dl><dt>t</dt><dd>d</dd><dt>u</dt><dt>v</dt><dd> </dd></dl><p><b>x</b> y</p><div class="summary"><p>k &amp; <b>l</b></p><li><b></b>m</li></div>'
    made = sections.metadata_inventory(pages.tokenize(spark.createDataFrame([(1, html)], "id int, html string"), "id"), "id")
    rows = sorted((r["kind"], r["text"], r["detail"]) for r in made.collect())
    assert [r[:2] for r in rows] == [("defined-term", "x"), ("glossary", "t"), ("glossary", "u"), ("glossary", "v"), ("heading", "A"), ("key-block", "k & l"), ("key-block", "m")]
    assert [r[2] for r in rows if r[0] == "glossary"] == ["d", None, None]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_gradient_reads_colours_once_a_pair(spark):
    from foliolens.operators import audits

    runs = spark.createDataFrame([(1, "#777777", "normal", ["#000000", "#ffffff"]), (2, "white", "large", ["#000", "#000"])], "id int, fg string, size string, stops array<string>")
    made = audits.gradient_contrast(runs, "id", "fg", "stops")
    assert sorted(tuple(r) for r in made.collect()) == [(1, 1.09, False), (2, 21.0, True)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "fg" not in plan[: plan.index("explode(")]
