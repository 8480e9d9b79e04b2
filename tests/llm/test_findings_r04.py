"""Cases of the findings of round 4 on training-data operators."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from axonlake.llm import decontam

SF = "/root/testdata/sf0.001"
#: Runs far beyond those of the given tables (1,202 names in check_l).
LONG = 50_000


@pytest.mark.parametrize(("start", "words", "fill"), [("said y", ["said", "y", "^"], " Anna"), ("said ", ["said", "#"], "1,")])
def test_runs_of_names_and_numbers_of_any_length_take_no_stack(spark, start, words, fill):
    # of constants, so that the patterns run in this call and not in a task
    text = F.concat(F.lit(start), F.repeat(F.lit(fill), LONG), F.lit(" Bob" if "^" in words else "2"))
    row = spark.range(1).select(decontam.template(text).alias("words"), decontam.slots(text).alias("fills")).first()
    run = (fill * LONG + (" Bob" if "^" in words else "2")).lower().strip().replace(" ", "\u0003")
    assert row["words"] == words and row["fills"] == [[]] * (len(words) - 1) + [[run]]


def test_an_item_behind_a_long_run_is_found(spark):
    item = "once a quiet river carried seven painted boats along the meadow towards a distant harbour"
    docs = [(1, "we met" + " Anna" * LONG + " and " + item), (2, "it says 1" + ".1" * LONG + " then " + item), (3, "we met" + " Anna" * LONG + " again")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["exact"]) for r in decontam.leaks(docs, bench).collect()} == {(1, 7, True), (2, 7, True)}
    bad = docs.unionByName(spark.read.parquet(f"{SF}/benchmark.parquet").select(F.lit(9).cast("long").alias("doc_id"), "text").limit(1))
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_benchmark(spark, bad, SF).collect()) == [1, 2, 3]
