"""Nothing of a text, a table or a column is passed over."""

import pytest
from pyspark.sql import functions as F

from fusionframe.llm import common, decontamination, langid, pii, toxicity, urls


def test_long_words_walk_the_trie():
    match = toxicity._Memo(("blark*",))
    assert [match["blark" + "x" * n] for n in (20, 70, 700)] == [2, 2, 2]
    assert match["y" * 100] == 0


def test_urls_with_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "http://www.example.com/en/x", 3, "h", "p")], "page_id long, url string, _hits int, host string, _page string")
    got = urls.judge_urls(frame).collect()[0]
    assert (got["_hits"], got["_page"], got.host, got.path, got.rule, got.verdict) == (3, "p", "www.example.com", "/en/x", "www.example.com/en/", "allow")


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "http://" + "a" * 100_000 + ".com/" + "b" * 100_000)], [(1, "")] * 3])
def test_urls_odd_rows(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "strict_hits")})
    got = urls.judge_urls(frame)
    assert got.count() == len(rows) and got.where("host = 'x'").count() == 0


def test_short_benchmark_items_are_found(spark):
    items = spark.createDataFrame([(1, "seven words are too few for masks"), (2, "red green blue grey"), (3, "yes"), (4, ""), (5, "one two three")], "item_id long, text string")
    docs = [(1, "So Seven words, are too few for MASKS they said " + "filler " * 50), (2, "a red green blue grey b"), (3, "red green blue and grey"), (4, "yes"), (5, "yes it is"), (6, "One, two: three."), (7, "one two three four"), (8, None)]
    got = {r.doc_id: r.leaked_items for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {1: [1], 2: [2], 3: [], 4: [3], 5: [], 6: [5], 7: [], 8: []}


def test_dictionaries_hold_all_parts_of_texts(spark):
    text = "".join(f"w{i:06d} " for i in range(40_000))  # 320,000 letters
    got = langid.learn(spark.createDataFrame([(text, "aa"), ("short text", "bb")], "text string, lang string"))
    assert got["bb"] == b"short text"
    assert 40_000 < len(got["aa"]) < 90_000
    places = [text.find(got["aa"][i:i + 100].decode()) for i in range(0, len(got["aa"]) - 200, 201)]
    assert min(places) < 20_000 and max(places) > 300_000


def test_pseudonyms_ask_for_a_key(spark):
    with pytest.raises(ValueError):
        pii.session_key(spark)
    assert pii.session_key(spark, b"k") == b"k"


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(5000)] + [(f"k{i}", i) for i in range(300)], "k string, i long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("payload", F.concat(F.lit("p"), "k"))
    got = common.salted_join(left, right, "k", "n", 5300, ["i"])
    assert sorted(map(tuple, got.select("k", "i", "payload").collect())) == sorted((r.k, r.i, "p" + r.k) for r in left.collect())


def test_drop_between_keeps_the_others(spark):
    frame = spark.range(3)
    first, mark = common.materialize(frame, "a"), common.written()
    gone, kept = common.materialize(frame, "b"), common.materialize(frame, "c")
    common.drop_between(spark, mark, common.written() - 1)
    assert first.count() == kept.count() == 3 and common.written() == mark + 1
    with pytest.raises(Exception):
        gone.collect()
