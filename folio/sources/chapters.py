"""Posts as chapters of a book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import js
from folio.operators.markup import html_to_blocks, rich_text_to_blocks, with_blocks
from folio.operators.queue import clean_title


def _blocks(source: str) -> list[dict]:
    """source: h and HTML, or d and a rich-text document."""
    return html_to_blocks(source[1:]) if source[0] == "h" else rich_text_to_blocks(source[1:]) or []


def post_chapters(posts: DataFrame, id_: str, book: str | None = None) -> DataFrame:
    """id_, title, blocks of posts(id_, title, html, document): HTML that isn't blank counts, else the document; the title
    without the book's name before it. A post whose blocks are all scene breaks, or that has none, is no chapter."""
    source = F.when(js.trim(F.col("html")) != "", F.concat(F.lit("h"), F.col("html"))).otherwise(F.concat(F.lit("d"), F.coalesce("document", F.lit(""))))
    made = with_blocks(posts.select(id_, "title", source.alias("_source")), "_source", _blocks)
    return made.where(~F.forall("blocks", lambda b: b["type"] == "hr")).select(id_, clean_title(F.col("title"), F.lit(book or "")).alias("title"), "blocks")
