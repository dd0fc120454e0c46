"""Pages that stand whole and in order are read where they lie."""

from foliolens.operators import pages as P
from foliolens.operators import sections as S
from foliolens.plans.sections import _order_pages

PAGES = [
    '<html><head><title>t</title></head><body>loose &amp; <h2 id="own">A</h2><p>b <i>c</i></p><p/> <div data-plan-label="L"><style>p{}</style><p>in</p></div></body></html>',
    "", "<p>one<p>two</div> < 3 </p>tail<br/>", '<ul><li>x<p id="inner">y</p></li></ul><div class="page-footer"><p>no</p></div><hr DATA-PLAN-LABEL=z><!-- c --><script>if (a < b) {}</script>', "only text",
]


def rows(df):
    return sorted(map(str, df.collect()))


def test_pages_that_stand_whole_give_the_same_without_a_shuffle(spark):
    pages = spark.createDataFrame([(i, PAGES[i % len(PAGES)]) for i in range(40)], "k long, html string").repartition(3)
    tokens = P.tokenize(pages, "k")
    operators = {
        "elements": P.elements, "blocks": P.text_blocks, "left out": lambda t, k, whole: P.text_blocks(t, k, without=P.ADDED, whole=whole), "ids": P.block_ids, "plan": S.plan_blocks, "runs": S.text_runs,
        "chrome": lambda t, k, whole: P.chrome_counts(t, k, ("ul li", "p"), whole), "enclosing": lambda t, k, whole: P.enclosing(t, k, whole=whole, a=("div p", "li"), b=("p",)),
    }
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # blocks go on from batch to batch
    try:
        for name, operator in operators.items():
            assert rows(operator(tokens, "k", whole=True)) == rows(operator(tokens, "k", whole=False)), name
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("blocks", "ids", "plan", "runs", "enclosing"):
        assert plan(operators[name](tokens, "k", whole=True)).count("Exchange") == plan(tokens).count("Exchange"), name


def test_blocks_of_a_page(spark):
    tokens = P.tokenize(spark.createDataFrame([(0, PAGES[0])], "k long, html string"), "k")
    got = [(r["block_idx"], r["tag"], r["text"], r["summary"], r["html"]) for r in sorted(S.plan_blocks(tokens, "k").collect(), key=lambda r: r["block_idx"])]
    assert got == [
        (0, None, "loose &", "Text: loose &", "loose &amp; "), (1, "h2", "A", "Heading: A", '<h2 id="own">A</h2>'), (2, "p", "b c", "Paragraph: b c", "<p>b <i>c</i></p>"), (3, "p", "", "Paragraph", "<p/>"),
        (4, "div", "in", "L", "<div><style>p{}</style><p>in</p></div>"),
    ]


def test_pages_of_orders_take_one_shuffle(spark):
    from pyspark.sql import functions as F

    plan = _order_pages(spark, "/root/testdata/sf0.001", F.lit("<p>x</p>"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
