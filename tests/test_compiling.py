"""The compiler's steps on one page's tree, and the compilation as a Spark job."""

import random

import pytest

from foliolens.functions import selectors
from foliolens.operators import compiling, steps
from foliolens.operators.tree import parse, write

FACTS = {"section": "s1", "base": None, "title": "Cells", "canonical_url": "https://h.org/cells", "book": "Biology", "book_url": "https://h.org/", "publisher": "Pub", "authors": ["A", "B"], "license": "CC BY 4.0", "license_url": "https://cc.org/by", "xrefs": {}, "answers": {}, "edits": [], "images": []}
UUID = "0f0e0d0c-0b0a-4909-8807-060504030201"
HASH = "ab" * 20


def ran(source, *only, publisher="document", **facts):
    html, error, notes, queue = steps.compiled(source, FACTS | facts, steps.PUBLISHERS[publisher], only or steps.STEPS)
    assert error is None, error
    return html, {(s, m): n for s, m, n in notes}, queue


def test_tree_round_trip():
    source = '<p class="a &amp; b">x &amp; y<br>z<b>q</b></p><ul><li>1</li><li>2</li></ul>'
    assert write(parse(source)) == source
    assert write(parse("<html><head><title>t</title></head><body><p>a<p>b</body></html>")) == "<p>a<p>b</p></p>"
    assert write(parse("<div><b>x</div> 1 < 2 </i>")) == "<div><b>x</b></div> 1 &lt; 2 "
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000
    assert write(parse(deep)) == deep


def test_selectors():
    tree = parse('<nav id="toc"><p class="x y">1</p></nav><div class="y"><span data-type="media">2<p>3</p></span></div>')
    found = lambda s: [n.plain() for n in tree.all(s)]
    assert found("nav#toc") == ["1"] and found("p.x.y") == ["1"] and found("div p, nav") == ["1", "3"]
    assert found('span[data-type="media"]') == found("[data-type=media]") == found("div.y [data-type]") == ["23"]
    assert found("nav span") == [] and found("*") == ["1", "1", "23", "23", "3"]
    with pytest.raises(ValueError):
        selectors.parse("p > a")


def test_chrome_and_counts():
    html, notes, _ = ran('<nav id="toc"><nav>a</nav></nav><p>b</p><style>p{}</style><footer>c</footer>', steps.strip_chrome, publisher="pressbooks")
    assert html == "<p>b</p>" and notes == {("strip-chrome", "chrome removed"): 4}
    assert ran('<nav id="toc">a</nav><nav>b</nav>', steps.strip_chrome, publisher="openstax")[0] == "<nav>b</nav>"


def test_addresses():
    packed = "$IMS-CC-FILEBASE$/packaged/a-1.png"
    source = f'<a href="#f">1</a><a href="x/y">2</a><img src="{packed}"><img src="http://o.org/i.png"><a href="http://o.org/">3</a><a href="http://h.org/z">4</a><a href="./{UUID}@1:{UUID}">5</a><a href="http://[bad">6</a>'
    html, notes, _ = ran(source, steps.absolute_addresses, publisher="openstax", base="https://h.org/b/c")
    assert html == f'<a href="#f">1</a><a href="https://h.org/b/x/y">2</a><img src="{packed}"><img src="https://o.org/i.png"><a href="http://o.org/">3</a><a href="https://h.org/z">4</a><a href="./{UUID}@1:{UUID}">5</a><a href="http://[bad">6</a>'
    assert notes == {("absolutize", "addresses made absolute"): 3, ("absolutize", "addresses moved to https"): 2, ("absolutize", "addresses left that can't be read: http://[bad"): 1}


def test_equations():
    html, notes, _ = ran(r'<img class="ql-img-inline" alt="\(x^{2}\)"><img class="ql-img-displayed" alt="$$y$$"><img class="ql-img-x" alt="\(a{\)"><img src="a.png" alt="z">', steps.recover_equations, publisher="pressbooks")
    assert html.count("<math") == 2 and '<math display="block"><semantics><mtext>y</mtext>' in html and html.count("<img") == 2
    assert notes == {("math", "equations, 2 of them recovered from TeX"): 2}
    html, _, _ = ran(r"<p>a \(b &lt; c\) d \[e\] \(f{\)</p><pre>\(g\)</pre>", steps.recover_equations)
    assert html.count("<math") == 2 and "<mtext>b &lt; c</mtext>" in html and r"\(f{\)" in html and r"<pre>\(g\)</pre>" in html


def test_figures_inside_and_beside():
    html, notes, _ = ran('<figure><img src="a.png"><figcaption>Figure 1</figcaption></figure><figure id="f"><p>no caption</p></figure>', steps.restructure_figures)
    assert html == '<div class="figure-block" id="fig-0"><img src="a.png" aria-describedby="cap-fig-0"><p class="figure-caption" id="cap-fig-0">Figure 1</p></div><div class="figure-block" id="f"><p>no caption</p></div>'
    assert notes == {("figures", "caption of fig-0 is only a label: Figure 1"): 1, ("figures", "figures restructured"): 2}
    beside = '<figure><span data-type="media"><img src="a.png"></span></figure> <div class="os-caption-container"><span>Figure 2</span> <span class="os-caption">A\n cell.</span></div><p>x</p>'
    html, _, _ = ran(beside, steps.restructure_figures, publisher="openstax")
    assert html == '<div class="figure-block" id="fig-0"><img src="a.png" aria-describedby="cap-fig-0"><p class="figure-caption" id="cap-fig-0">Figure 2 A cell.</p></div> <p>x</p>'
    _, _, queue = ran(beside, publisher="openstax")
    assert [(q["kind"], q["caption"], q["proposed"]) for q in queue] == [("alt", "Figure 2 A cell.", "A cell.")]


GRID = "<p>The rates by year. They rise.</p><table id='t'><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td>e</td><td>f</td></tr></table>"


def test_tables():
    html, notes, queue = ran(GRID, steps.fix_tables)
    assert "<caption style=\"text-align: center\">The rates by year. They rise.</caption>" in html and html.count("background-color: #f2f2f2") == 1 and 'width="100%" border="1"' in html
    assert [(q["kind"], q["element_id"], q["reference"]) for q in queue] == [("table-headers", "t", "The rates by year. They rise.")]
    html, _, queue = ran(GRID, steps.fix_tables, answers={"s1::t": {"type": "table-headers", "choice": "both"}})
    assert html.count("<th") == 4 and html.count('scope="col"') == 1 and html.count('scope="row"') == 2 and not queue
    assert 'role="presentation"' in ran(GRID, steps.fix_tables, answers={"s1::t": {"type": "table-headers", "choice": "presentation"}})[0]


@pytest.mark.parametrize(("table", "choice", "reason"), [
    ("<table></table>", "row", "it has no rows"), ("<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>", "row", "it contains another table"), ("<table><tr><td rowspan=2>a</td></tr><tr></tr></table>", "row", "a cell spans rows"),
    ("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>", "row", "its rows differ in width"), ("<table><tr><td colspan=2>a</td></tr><tr><td>b</td><td>c</td></tr></table>", "row", "a cell of the band spans columns"),
    ("<table><tr><td>b</td><td>c</td></tr><tr><td colspan=2>a</td></tr></table>", "row", None), ("<table><tr><td>b</td><td>c</td></tr><tr><td colspan=2>a</td></tr></table>", "column", "a cell of the band spans columns"),
])
def test_refused_headers(table, choice, reason):
    assert steps.refusal(parse(table).first("table"), choice) == reason
    if reason:
        _, notes, queue = ran(table, steps.fix_tables, answers={"s1::table-0": {"type": "table-headers", "choice": choice}})
        assert notes["tables", f"table headers refused: {reason}"] == 1 and "table-0" in [q["element_id"] for q in queue]


def test_links():
    other = "1" + UUID[1:]
    source = f'<h2 id="q">Why <b>cells</b></h2><a href="#q">here</a><a href="mailto:a@b.c?x">click here</a><a href="https://h.org/some_page-two.html">Read more</a><a href="https://h.org/">https://h.org/</a><a href="https://h.org/x">fine</a><a href="./{UUID}@1:{UUID.upper()}.xhtml#f">5</a><a href="./{UUID}@1:{other}">6</a>'
    html, notes, _ = ran(source, steps.fix_links, publisher="openstax", xrefs={UUID: "https://h.org/five"})
    assert ">Go to Why cells</a>" in html and ">Email a@b.c</a>" in html and ">Read more about some page two</a>" in html and ">Read more about h.org</a>" in html and ">fine</a>" in html
    assert 'href="https://h.org/five#f"' in html and f'<a href="https://h.org/" data-xref="{other}">6</a>' in html
    assert notes == {("links", "links inside the book resolved"): 1, ("links", f"links inside the book without a page: {other}"): 1, ("links", "link texts made to say where they lead"): 4}


def test_text_semantics():
    html, notes, _ = ran('<b>1</b><i>2</i><u>3</u><a href="/x"><u>4</u></a><span style="text-decoration: underline; color: red">5</span>', steps.text_semantics)
    assert html == '<strong>1</strong><em>2</em><span style="text-decoration: none">3</span><a href="/x"><u>4</u></a><span style="text-decoration: none; color: red">5</span>'
    assert notes == {("text-semantics", "presentational tags replaced"): 2, ("text-semantics", "underlines outside links removed"): 2}


def test_contrast():
    html, notes, _ = ran('<p style="color: #ccc">1</p><div style="background-color: #000"><p style="color: #222; margin: 0">2</p><font color="white">3</font></div><font color="yellow">4</font><p style="color: var(--x)">5</p>', steps.fix_contrast)
    assert '<p style="color: #2d3b45">1</p>' in html and '<p style="color: #ffffff; margin: 0">2</p>' in html and '<font color="white">3' in html and '<font color="#2d3b45">4' in html and "var(--x)" in html
    assert notes == {("contrast", "text colours of low contrast replaced"): 3}


def test_pictures():
    source = f'<p>Look here.</p><img src="1.png"><img src="2.png" alt=""><img src="3.png" alt="A cell under the microscope"><img src="4.png" alt="image of a cell wall"><img src="5.png" alt="photo.jpg"><img src="6.png" role="presentation"><img src="https://r.org/{HASH}" alt="">'
    _, notes, queue = ran(source, steps.resolve_alt, publisher="openstax")
    assert [(q["kind"], q["element_id"], q["current"]) for q in queue] == [("alt", "img-0", None), ("confirm-decorative", "img-1", None), ("alt", "img-3", "image of a cell wall"), ("alt", "img-4", None), ("confirm-decorative", "img-6", None)]
    assert {q["reference"] for q in queue} == {"Look here."} and queue[-1]["hash"] == HASH
    assert notes == {("alt", "declared decorative"): 1, ("alt", "trusted as described"): 1}
    html, notes, queue = ran(source, steps.resolve_alt, publisher="openstax", answers={HASH: {"type": "decorative"}, "s1::img-0": {"type": "alt", "text": "A leaf in autumn"}})
    assert 'alt="A leaf in autumn"' in html and len(queue) == 3 and notes["alt", "confirmed decorative"] == notes["alt", "described by people"] == 1
    long = "A cell wall seen from above. " * 6
    html, notes, queue = ran(f'<img src="x" alt="{long}">', steps.resolve_alt)
    assert not queue and notes["alt", "texts shortened to the limit"] == 1 and len(parse(html).first("img").attrs["alt"]) <= 120


def test_edits_and_added_pictures():
    plain, _, _ = ran("<h2>One</h2><p>The crazy and crazy plan. CRAZY</p>")
    block = parse(plain).first("p").attrs["id"]
    edits = [{"element_id": block, "occurrence": 1, "original": "crazy", "kind": "replace", "replacement": "bold", "context": None}, {"element_id": block, "occurrence": 0, "original": "CRAZY", "kind": "replace", "replacement": "wild", "context": None},
             {"element_id": block, "occurrence": 0, "original": "plan", "kind": "keep", "replacement": None, "context": "as then called"}, {"element_id": block, "occurrence": 5, "original": "crazy", "kind": "replace", "replacement": "x", "context": None}]
    image = {"asset": "lab-1.jpg", "target": block, "mode": "after", "alt": "Two students", "width": 8, "height": 6, "caption": "A lab.", "credit": "“Lab” by A, CC BY-SA 4.0", "source_url": "https://c.org/l", "license": "CC BY-SA 4.0", "license_url": "https://cc.org/sa", "share_alike": True}
    html, notes, _ = ran("<h2>One</h2><p>The crazy and crazy plan. CRAZY</p>", edits=edits, images=[image, image | {"asset": "b.jpg", "target": "gone"}])
    assert ">The crazy and bold plan (as then called). WILD</p>" in html and "Modified from the original" in html
    assert 'src="$IMS-CC-FILEBASE$/packaged/lab-1.jpg"' in html and "share-alike" in html and 'id="cap-fig-added-lab-1.jpg">A lab. “Lab” by A, CC BY-SA 4.0 (' in html
    assert notes["edits", "edits applied"] == 4 and notes["edits", "edits whose words are gone"] == 1 and notes["images", "added pictures whose place is gone"] == 1


SAMPLE = f'<h1>Cells</h1><h4>Deep</h4><p>See <a href="#x">here</a> <b>now</b>.</p><figure><img src="a.png"><figcaption>Credit: X</figcaption></figure>{GRID}<p style="color:#ddd">pale</p><img src="/b.png" alt="">'


@pytest.mark.parametrize("publisher", steps.PUBLISHERS)
def test_compiling_again_changes_nothing(publisher):
    rng = random.Random(7)
    parts = [SAMPLE, "<h3>x</h3>", "<u>y</u>", "<div><table><tr><th>a</th></tr></table></div>", "<h2>t</h2>", "</p>", "<li>q", "text & more ", '<font color="silver">z</font>', "<figure><figure><img></figure></figure>"]
    for _ in range(40):
        source = "".join(rng.choices(parts, k=rng.randrange(1, 6)))
        once, _, queue = ran(source, publisher=publisher, base="https://h.org/a/")
        again, _, same = ran(once, publisher=publisher, base="https://h.org/a/")
        assert again == once
        assert sorted((q["kind"], q["element_id"]) for q in same) == sorted((q["kind"], q["element_id"]) for q in queue)


def test_spark_job_with_decisions_and_a_failing_page(spark):
    ref = f'<a href="./{UUID}@1:{UUID}#z">five</a><img src="https://r.org/{HASH}">'
    rows = [("a", "<h2>A</h2>" + ref + GRID, "https://h.org/"), ("b", ref, "https://h.org/"), ("c", "<p>x</p>", "not an address"), ("d", None, None), ("e", "", None)]
    sections = spark.createDataFrame(rows, "section_id string, html string, base string")
    xrefs = spark.createDataFrame([(UUID.upper(), "https://h.org/five"), ("f" * 8 + UUID[8:], "https://h.org/none")], "name string, url string")
    answers = spark.createDataFrame([(HASH, "alt", "A cell under glass", None), ("a::t", "table-headers", None, "row"), ("zz::t", "decorative", None, None)], "queue_key string, type string, text string, choice string")
    edits = spark.createDataFrame([("a", 1, "x", 0, "q", "replace", "w", None)], "section_id string, ord int, element_id string, occurrence int, original string, kind string, replacement string, context string")
    done = compiling.compile_sections(sections, publisher="openstax", xrefs=xrefs, answers=answers, edits=edits)
    got = {r["section_id"]: r for r in done.sections.collect()}
    assert got["a"]["html"].count('scope="col"') == 2
    assert all('href="https://h.org/five#z"' in got[k]["html"] and 'alt="A cell under glass"' in got[k]["html"] for k in "ab")
    assert got["c"]["html"] == "" and got["c"]["error"] == "ValueError: not an absolute address: not an address" and got["d"]["error"] == "no page" and got["e"]["error"] is None
    notes = done.notes.collect()
    assert {r["section_id"] for r in notes} == {"a", "b", "e"} and ("a", "edits whose words are gone") in {(r["section_id"], r["message"]) for r in notes}
    assert done.queue.count() == 0
    free = compiling.compile_sections(sections, publisher="openstax")
    assert sorted(r["queue_key"] for r in free.queue.collect()) == ["a::t", HASH, HASH]
    again = compiling.recompile_sections(sections, spark.createDataFrame([("b",)], "section_id string"), publisher="openstax", once=False)
    assert [r["section_id"] for r in again.sections.collect()] == ["b"]


def test_no_sections(spark):
    done = compiling.compile_sections(spark.createDataFrame([], "section_id long, html string"))
    assert done.sections.count() == done.notes.count() == done.queue.count() == 0
