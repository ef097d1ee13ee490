"""Chapters, blocks and marks in whole, on small inputs."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from folio.plans import registry
from folio.runtime import ship, slices
from folio.sources import chapters, files


@pytest.fixture(autouse=True, scope="module")
def _shipped(spark):
    ship(spark)


def test_posts_without_text_are_no_chapters(spark):
    document = '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"rich"}]}]}'
    rows = [
        (1, "Book: One", "<p>a</p><hr><p>b</p>", document), (2, "Two", " \n", document), (3, "Three", "<hr>", document), (4, "Four", None, None), (5, "Five", "", "{"),
        (6, "BOOK - Six", "<p>* * *</p>", None), (7, "Bookish", "x", None),
    ]
    posts = spark.createDataFrame(rows, "id int, title string, html string, document string")
    got = {r["id"]: (r["title"], [b["text"] for b in r["blocks"]]) for r in chapters.post_chapters(posts, "id", "Book").collect()}
    assert got == {1: ("One", ["a", "* * *", "b"]), 2: ("Two", ["rich"]), 7: ("Bookish", ["x"])}


def test_a_render_makes_each_form_where_it_is_asked_for(spark):
    from folio.operators import rules, sheets

    rows = [(1, 0, "p", "10% plain", None), (1, 1, "p", "x", "blockquote"), (1, 2, "li", "one", None), (1, 3, "p", "y", None), (1, 4, "p", "[a][b]", None), (1, 5, "li", "[c] 5%", None), (1, 6, "hr", "* * *", None), (1, 7, "p", "z", "h2")]
    blocks = spark.createDataFrame(rows, "doc_id int, block_no int, type string, text string, role string").withColumns({"runs": F.lit(None).cast("array<struct<text:string,marks:array<string>,br:boolean>>"), "align": F.lit(None).cast("string")})
    html = sheets.render(blocks, rules.Rules(percent=False)).first()["html"].split("\n")
    assert html == [
        "<p>10% plain</p>", "<blockquote><p>x</p></blockquote>", '<ul class="stat-block"><li>one</li></ul>', "<p>y</p>",
        '<div class="stat-sheet"><div class="stat-line">[a][b]</div><ul class="stat-block"><li>[c] 5%</li></ul></div>', '<hr class="scene-break" />', "<h2>z</h2>",
    ]


def test_numbers_and_repeated_lines_of_texts_are_no_heads(spark, tmp_path):
    texts = ["a b c d e f g h 4880761348116108", " ".join(["the"] * 960 + ["end."]), "Of " * 500 + "it 7"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["q_chapter_blocks"](spark, str(tmp_path)).select("doc_id", "block_no", "text", "type").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(registry.ORACLE_SQL["q_chapter_blocks"]).fetchall())


def test_lines_of_chapters_are_made_once_and_leave_no_shuffle_files(spark, tmp_path):
    """Glyphs were dealt out twice, once for the heads and once for what they are taken from, and stayed on the disk."""
    files = lambda: sum("shuffle_" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    spark.createDataFrame([(i, "word " * 900) for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = files()
    plan = registry.QUERIES["q_chapter_blocks"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    for _ in range(50):  # they are removed in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before


def test_long_texts_of_a_batch_are_taken_in_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["a" * 60, None, "b" * 60, "c" * 300, "", "é"], "n": list(range(6))})
    assert [p.column("n").to_pylist() for p in slices(batch, "t", 100)] == [[0, 1], [2], [3], [4, 5]]
    assert list(slices(batch.slice(0, 0), "t")) == []


def test_a_text_file_is_read_in_pieces_as_it_is_in_whole():
    for content in (b"", b"\f", "é\n \x1c\nb\f\fc\r\nlast".encode(), b"a\nb\n", b"a\xffb\x80", "é".encode()[:1], b"x\xe2\x28\xa1", b"\xff\x00"):
        for n in (1, 2, 3, 100):
            try:
                pages, want = files.text_pages(content), None
            except ValueError as e:
                pages, want = [], str(e)
            try:
                count, found = files.text_stream(lambda: (content[i : i + n] for i in range(0, len(content), n)))
                assert (count, list(found), want) == (len(pages), [(i, k, f) for i, p in enumerate(pages, 1) for k, f in enumerate(p)], None)
            except ValueError as e:
                assert str(e) == want


def test_scene_breaks_are_looked_for_in_short_texts(spark):
    """A page's text has eleven symbols or more, which is seen before it is copied."""
    from folio.functions import text

    texts = ["* * *", "*" * 10, "*" * 11, " ~ ~ ", "~", "😀" * 5, "😀" * 6, "a a", "word " * 400, "", None, "\n#﻿# "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.coalesce(1).select(text.is_scene_break(F.col("t"))).collect()] == [True, True, False, True, False, False, False, False, False, False, False, True]
