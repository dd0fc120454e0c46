"""Closed forms against loops, and odd input."""

import random

import pytest
from pyspark.sql import functions as F

from foliolens.functions import color as C
from foliolens.functions import text as T
from foliolens.operators import audits, corpora, pages, publishing
from foliolens.operators import queues as Q
from foliolens.streaming import folds


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def tokens(spark, *htmls):
    return pages.tokenize(spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string"), "page_id")


@pytest.mark.parametrize(
    ("html", "kinds"),
    [
        ('<p title="a>b">x</p>', [("open", "p"), ("text", None), ("close", "p")]),
        ("<!-- <p> --><br/>a < b", [("open", "br"), ("text", None), ("text", None), ("text", None)]),
        ("<script>if (a<b) '</p>'</script>t", [("raw", "script"), ("text", None)]),
        ("<!doctype html><P>", [("open", "p")]),
        ("<!-- never closed <p>", []),
    ],
)
def test_tokens(spark, html, kinds):
    assert [(r["kind"], r["tag"]) for r in tokens(spark, html).orderBy("pos").collect()] == kinds


def test_long_tags(spark):
    html = '<a href="' + "x" * 200_000 + '"' + " k=1" * 20_000 + ">"
    row = tokens(spark, html).first()
    assert row["tag"] == "a" and len(row["attrs"]) == 20_001


def test_tree_of_broken_markup(spark):
    tree = pages.elements(tokens(spark, "<div><p>a<b>c</div><p>d</i></p>"), "page_id").orderBy("el").collect()
    assert [(r["tag"], r["depth"], r["path"], r["parent"]) for r in tree] == [("div", 0, [], None), ("p", 1, ["div"], 0), ("b", 2, ["div", "p"], 1), ("p", 0, [], None)]


def test_sanitize(spark):
    html = "<main><h1 onclick=x class=k>A</h1><a href='javascript:x' href=\"/b\" target=_BLANK>l</a><script>s</script><img src=data:x alt=''></main>"
    made = pages.sanitize(tokens(spark, html), "page_id").first()["html"]
    assert made == '<h2 class="k">A</h2><a href="/b" target="_blank">l</a><img alt="">'


def test_relevel_equals_loop(spark):
    rng = random.Random(1)
    docs = [[rng.randrange(1, 7) for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    rows = [(d, i, level, i + 1) for d, levels in enumerate(docs) for i, level in enumerate(levels)]
    got = {(r["page_id"], r["pos"]): r["new_level"] for r in pages.relevel(spark.createDataFrame(rows, "page_id int, pos int, level int, n int"), "page_id").collect()}
    for d, levels in enumerate(docs):
        before = 1
        for i, level in enumerate(levels):
            before = min(min(6, max(2, level - min(levels) + 2)), before + 1)
            assert got[d, i] == before


def test_unique_names_with_natural_collision(spark):
    rows = [("e", i, t) for i, t in enumerate(["a", "a", "a-2", "b", "a"])] + [("f", 0, "a"), ("f", 1, "a")]
    made = publishing.unique_names(spark.createDataFrame(rows, "g string, i int, base string"), "g", "base", ["i"], "name")
    assert [r["name"] for r in made.orderBy("g", "i").collect()] == ["a", "a-2", "a-2-2", "b", "a-3", "a", "a-2"]


def test_asset_budget_equals_loop(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.choice([0, 10, 60, 200])) for d in range(6) for i in range(rng.randrange(1, 12))]
    got = {(r["d"], r["i"]): r["refused"] for r in publishing.asset_budget(spark.createDataFrame(rows, "d int, i int, size int"), "d", "i", "size", most=8, each=100, total=200).collect()}
    total = {}
    for n, (d, i, size) in enumerate(rows):
        reason = "too-many" if i >= 8 else "empty" if not size else "too-large" if size > 100 else None
        if reason is None:
            total[d] = total.get(d, 0) + size
            reason = "over-total" if total[d] > 200 else None
        assert got[d, i] == reason, n


def test_text_functions(spark):
    assert one(spark, T.decode_entities(F.lit("&amp;lt; &#65;&#x1F600; &nope; &copy;&"))) == "&lt; A😀 &nope; ©&"
    assert one(spark, T.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, T.slug(F.lit("  Ünïque -- Title! "))) == "n-que-title"
    assert one(spark, T.slug(F.lit("!!"))) == "page"
    assert one(spark, T.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, T.fit_alt(F.lit("First sentence that is long. " + "w" * 40 + " " + "x" * 90))) == "First sentence that is long."
    assert one(spark, T.first_sentence(F.lit("See Dr. Smith in Fig. 3 for more about it. Then go."))) == "See Dr. Smith in Fig. 3 for more about it."
    assert one(spark, T.paragraphize(F.lit("a<b\nc\n\n\nd"))) == "<p>a&lt;b<br>c</p><p>d</p>"
    assert one(spark, pages.absolutize(F.lit("../x/./y?q#f"), F.lit("https://h.example/a/b/c"))) == "https://h.example/a/x/y?q#f"
    assert one(spark, pages.absolutize(F.lit("//o.example/z"), F.lit("http://h.example/"))) == "http://o.example/z"


def test_colors(spark):
    read = lambda c: one(spark, C.parse_color(F.lit(c)))
    assert tuple(read("#abc")) == (170, 187, 204, 1) and tuple(read("rgb(10% 20% 30% / 50%)")) == (25.5, 51, 76.5, 0.5)
    assert read("transparent") is None and read("#12345") is None and read("rgb(1,2)") is None
    assert round(one(spark, C.contrast_ratio(C.parse_color(F.lit("#777")), C.parse_color(F.lit("white")))), 2) == 4.48


def test_alt_rules(spark):
    cases = {"photo_12.JPG": "alt-text-filename", "www.x.org/a": "alt-text-url", "Screenshot 4": "alt-text-placeholder", "image: cat sits": "alt-text-redundant", "Chart, bar chart": "alt-text-machine-generated", "cat": "alt-text-too-short", "x" * 121: "alt-text-too-long", "A cat on a mat": None, " ": None}
    for text, issue in cases.items():
        assert one(spark, audits.alt_issue(F.lit(text))) == issue, text


def test_proper_nouns(spark):
    text = "Yesterday we met Ada Lovelace. Ada Lovelace spoke. Then Ada left and Ada Lovelace too. We like Ada"
    rows = corpora.proper_nouns(spark.createDataFrame([(1, text)], "k int, text string"), "k").collect()
    assert [(r["name"], r["total"], r["mid"]) for r in rows] == [("Ada Lovelace", 3, 3)]


def test_replacements_and_ranges(spark):
    assert one(spark, corpora.nth_replaced(F.lit("a.b a.b a.b"), F.lit("a.b"), F.lit("X"), F.lit(1))) == "a.b X a.b"
    assert one(spark, corpora.nth_replaced(F.lit("a"), F.lit("b"), F.lit("X"), F.lit(0))) is None


def test_stream_folds_equal_batch(spark, tmp_path):
    rows = [(i % 5, i, ["answer", "skip", "view"][i % 3]) for i in range(40)]
    batch = spark.createDataFrame(rows, "key long, seq long, type string")
    for part in range(4):
        batch.filter(F.col("seq") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = folds.fold_latest(stream, "key", "seq", "type").writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = {r["key"]: r for r in spark.sql("SELECT key, max_by(type, seq) AS type, max(seq) AS seq FROM folded GROUP BY key").collect()}
    assert {k: (r["type"], r["seq"]) for k, r in got.items()} == {r["key"]: (r["type"], r["seq"]) for r in Q.latest(batch, "key", "seq").collect()}


def test_import_sanitizer(spark):
    from foliolens.operators import imports

    html = '<svg><p>gone</p></svg><form><p onclick="x" class="k" id="a">t</p></form><a href="data:x">d</a><a href="../r">r</a><img src="mailto:x" alt="y"><main>m</main>'
    page = tokens(spark, html)
    made, removals = imports.sanitize_import(page, pages.elements(page, "page_id"), "page_id", "https://h.example/a/b")
    assert made.first()["html"] == '<p id="a">t</p><a>d</a><a href="https://h.example/r">r</a><span>[Embedded image: y]</span>m'
    found = sorted((r["code"], r["item"]) for r in removals.collect())
    assert found == [("active-removed", "form"), ("active-removed", "svg"), ("dangerous-url", "a.href"), ("dangerous-url", "img.src"), ("image-unavailable", "mailto:x"), ("relative-link", "a.href"), ("unsafe-attribute", "onclick"), ("unsupported", "main")]


def test_find_terms_of_any_length(spark):
    phrases = ["let the cat out of the bag", "hit the nail on the head", "cat", "cost an arm and a leg"]
    rules = spark.createDataFrame([(i, p, None) for i, p in enumerate(phrases)], "rule_id int, phrase string, replacement string")
    blocks = spark.createDataFrame([(1, "Don't let the cat out of the bag: it cost an ARM and a leg"), (2, "hit the nail"), (3, None)], "id int, text string")
    hits = {(r["id"], r["word"], r["rule_id"]) for r in corpora.find_terms(blocks, rules, ["id"]).collect()}
    assert hits == {(1, 2, 0), (1, 4, 2), (1, 10, 3)}
    assert corpora.find_terms(blocks, rules.limit(0), ["id"]).collect() == []
    with pytest.raises(ValueError, match="7 words"):
        corpora.find_terms(blocks, rules, ["id"], longest=4)


def test_plan_edits_equal_a_loop(spark):
    """Renames, merges, moves and splits, possible and impossible ones, replayed one after another."""
    import random

    from foliolens.operators import publishing

    rng = random.Random(3)
    pages, log, expected = [], [], []
    for doc in range(40):
        plan, at = [], 0
        for n in range(rng.randrange(1, 6)):
            blocks = list(range(at, at := at + rng.randrange(1, 5)))
            plan.append([f"{doc}-page-{blocks[0] + 1}", f"T{n}", True, blocks])
            pages.append((doc, n, *plan[-1]))
        rejected = []
        for seq in range(rng.randrange(8)):
            page = rng.choice([p[0] for p in plan] + ["gone"])
            op = rng.choice(["rename", "include", "merge-next", "move", "split"])
            value = {"rename": "New", "include": rng.choice(["true", "false"]), "move": str(rng.choice([-1, 1, 9])), "split": str(rng.randrange(at + 1)), "merge-next": None}[op]
            log.append((doc, seq, op, page, value))
            i = next((k for k, p in enumerate(plan) if p[0] == page), None)
            if i is None:
                rejected.append((doc, None, page, "no-such-page", False, []))
            elif op == "rename":
                plan[i][1] = value
            elif op == "include":
                plan[i][2] = value == "true"
            elif op == "merge-next" and i < len(plan) - 1:
                plan[i][3] = plan[i][3] + plan[i + 1][3]
                del plan[i + 1]
            elif op == "move" and 0 <= i + int(value) < len(plan):
                moved = plan.pop(i)
                plan.insert(i + int(value), moved)
            elif op == "split" and int(value) in plan[i][3][1:]:
                k = plan[i][3].index(int(value))
                plan.insert(i + 1, [f"{doc}-page-{int(value) + 1}", plan[i][1] + " (continued)", plan[i][2], plan[i][3][k:]])
                plan[i][3] = plan[i][3][:k]
            else:
                rejected.append((doc, None, page, f"impossible-{op}", False, []))
        expected += [(doc, n, *p) for n, p in enumerate(plan)] + rejected
    made = publishing.replay_plan_edits(spark.createDataFrame(pages, "doc int, page int, page_id string, title string, included boolean, blocks array<int>"), spark.createDataFrame(log, "doc int, seq long, op string, page_id string, value string"), "doc")
    assert sorted((tuple(r) for r in made.collect()), key=str) == sorted([(d, n, i, t, k, list(b)) for d, n, i, t, k, b in expected], key=str)
    assert {op for _, _, op, _, _ in log} == {"rename", "include", "merge-next", "move", "split"} and sum(t.startswith("impossible") for _, _, _, t, _, _ in expected) > 5


def test_unique_names_equal_a_loop(spark):
    """Names that meet generated ones, among many that don't, in one large group and in small ones."""
    import random

    from foliolens.operators import publishing

    rng = random.Random(8)
    for fold, suffix in ((False, "-{}"), (True, " ({})")):
        names = ["a", "a-2", "a-2-2", "A", "b", "b (2)", "B (2)", "c", "c-3", "a (2) (2)", "", "-2"] + [f"n{i}" for i in range(30)]
        rows = [(rng.choice(["g", "g", "h", "k"]), rng.choice(names), n) for n in range(300)]
        got = publishing.unique_names(spark.createDataFrame(rows, "g string, name string, n int"), "g", "name", ["n"], "made", suffix, fold).collect()
        taken, expected = {}, {}
        key = (lambda s: s.strip(" ").lower()) if fold else (lambda s: s)
        for group, name, n in rows:
            made, k = name, 2
            while key(made) in taken.setdefault(group, set()):
                made, k = name + suffix.format(k), k + 1
            taken[group].add(key(made))
            expected[n] = made
        assert {r["n"]: r["made"] for r in got} == expected and got[0].asDict().keys() == {"g", "name", "n", "made"}
