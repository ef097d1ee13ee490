"""Chapters mended as a whole against their blocks mended one by one."""

from pyspark.sql import functions as F

from folio.operators import vocabulary


def test_chapters_are_made_once_and_mended_in_place(spark):
    rows = [
        ("a", 1, [("p", "the after- noon"), ("h", "plain"), ("p", None), ("p", "well- known and re- do"), ("p", "x- ray after- noon")]),
        ("a", 2, [("p", "an afternoon")]), ("a", 3, None), ("a", 4, []), ("b", 1, [("p", "plain"), ("p", "after- noon"), ("p", "tail")]), (None, 1, [("p", "after- noon")]),
    ]
    df = spark.createDataFrame(rows, "book_id string, chapter_no int, blocks array<struct<type: string, text: string>>")
    chapters = df.withColumn("book_id", F.when(F.col("book_id") != "nosuchbook", F.col("book_id")))
    made = vocabulary.dehyphenate_chapters(chapters)
    assert "nosuchbook" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["book_id"], r["chapter_no"]): r["blocks"] and [tuple(b) for b in r["blocks"]] for r in made.collect()}
    assert got == {
        ("a", 1): [("p", "the afternoon"), ("h", "plain"), ("p", None), ("p", "well-known and re-do"), ("p", "x-ray afternoon")],
        ("a", 2): [("p", "an afternoon")], ("a", 3): None, ("a", 4): [], ("b", 1): [("p", "plain"), ("p", "after-noon"), ("p", "tail")], (None, 1): [("p", "after- noon")],
    }
