"""How much one task gets does not grow with the tables."""

from pyspark.sql import functions as F

from foliolens.operators import corpora as K
from foliolens.plans import catalog, registry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle_by_page_in_partitions_of_bounded_size(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert registry.dealt(rows, "id", 50).rdd.getNumPartitions() == 20
    assert plan(catalog.QUERIES["toc_of_items"](spark, DATA)).count("Exchange hashpartitioning") == 1


def test_parts_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(registry, "PARTS", 10)
    assert registry.table(spark, DATA, "part").rdd.getNumPartitions() == 20
    assert "Join" not in plan(catalog.QUERIES["links_inside"](spark, DATA))


def test_a_frontier_reads_its_links_once(spark):
    read = spark.sparkContext.accumulator(0)

    def told(src):
        read.add(1)
        return src

    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "c"), ("c", "d"), ("d", "b")], "src string, dst string").withColumn("src", F.udf(told)("src"))
    seeds = spark.createDataFrame([("x", "a"), ("y", "c")], "chapter string, url string")
    got = sorted((r["chapter"], r["url"], r["depth"]) for r in K.expand_frontier(seeds, links, None).collect())
    assert got == [("x", "a", 0), ("x", "b", 1), ("x", "c", 2), ("x", "d", 3), ("y", "b", 2), ("y", "c", 0), ("y", "d", 1)]
    assert read.value == 5


def test_hits_are_not_gathered(spark):
    """Texts that are the same in two rows give the hits of both, as the SQL says; rules that repeat count once; hits are not held to be compared."""
    texts = spark.createDataFrame([(1, "By the sea, by the way"), (1, "By the sea, by the way"), (2, "in a sea")], "doc_id long, text string")
    rules = spark.createDataFrame([(7, "by the", "near"), (7, "By the", "near"), (8, "in a", None)], "rule_id int, phrase string, replacement string")
    found = K.find_terms(texts, rules, ["doc_id"])
    assert sorted((r["doc_id"], r["word"], r["rule_id"], r["original"]) for r in found.collect()) == [(1, 1, 7, "By the"), (1, 1, 7, "By the"), (1, 4, 7, "by the"), (1, 4, 7, "by the"), (2, 1, 8, "in a")]
    assert "Exchange hashpartitioning(doc_id" not in plan(found) and "SortMergeJoin" not in plan(catalog.QUERIES["idioms_found"](spark, DATA))


def test_drafts_are_looked_up_without_broadcasts(spark):
    """Sides that grow with the input are not gathered by the driver, and quotes are looked up once, not for edits and observations apart."""
    found = catalog.QUERIES["findings_of_drafts"](spark, DATA)
    assert found.count() and "Broadcast" not in plan(found) and plan(found).count("min_by") <= 2
    found.collect()
    assert "BroadcastHashJoin" not in plan(found)


def test_quotes_of_sections_that_ask_for_many_grams(spark):
    quotes = spark.createDataFrame([(1, "abcdefghij"), (1, "nowhere at all"), (2, "xyz"), (2, "bc")], "s int, quote string")
    blocks = spark.createDataFrame([(1, 3, "..abcdefghij.."), (1, 5, "abcdefghij"), (2, 4, "wxyz"), (2, 1, "abc bc xyz")], "s int, b int, t string")
    for most in (0, 2, 4096):
        assert sorted(map(tuple, K.find_quotes(quotes, blocks, "s", "b", "t", most).select("s", "quote", "b").collect())) == [(1, "abcdefghij", 3), (2, "bc", 1), (2, "xyz", 1)]
