"""De-hyphenation by the words of the same book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.runtime import written

# Fixed values
SUFFIXES = ["ness", "tion", "ing", "ize", "ly", "ed", "es", "s"]
PREFIXES = ["dis", "re", "un", "in"]
# From a word's beginning and without going back in it, so that words without a hyphen are read once
WRAP = r"(?<!\p{L})\p{L}++[-‐][ \t]+\p{Ll}\p{L}*"


def vocabulary(texts: DataFrame, book: str = "book_id") -> DataFrame:
    """book, word: distinct lower-case words, those of broken halves too."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return texts.select(book, words.alias("word")).distinct()


def bases(word: Column) -> Column:
    """The word and what is left of it without one common ending or beginning."""
    n = F.length(word)
    found = [word]
    for s in SUFFIXES:
        fits = (n > len(s) + 2) & word.endswith(s)
        stem = F.substring(word, F.lit(1), n - len(s))
        found.append(F.when(fits, stem))
        if s in ("ing", "ed"):
            found.append(F.when(fits, F.concat(stem, F.lit("e"))))
    for p in PREFIXES:
        found.append(F.when((n > len(p) + 2) & word.startswith(p), F.substring(word, F.lit(len(p) + 1), n)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def hyphen_breaks(texts: DataFrame, book: str = "book_id", block: str = "block_no") -> DataFrame:
    """book, block, pos, left, right of each broken word."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(WRAP), F.lit(0)))
    return texts.select(book, block, found.alias("pos", "m")).select(book, block, "pos", F.regexp_extract("m", r"^(\p{L}+)", 1).alias("left"), F.regexp_extract("m", r"(\p{L}+)$", 1).alias("right"))


def _fixes(texts: DataFrame, book: str, block: str) -> DataFrame:
    """book, block, fixes: what stands for each broken word of a block that has any, in their order."""
    breaks = hyphen_breaks(texts, book, block)
    # A book's word is decided once, however often it is broken; halves too short have a key of their own, which is no word
    long, joined = (F.length("left") > 2) & (F.length("right") > 2), F.lower(F.concat("left", "right"))
    breaks = breaks.withColumn("whole", F.when(long, joined).otherwise(F.concat(F.lit("-"), F.xxhash64(block, "pos").cast("string"))))
    tried = breaks.where(long).select(book, "whole").distinct().select(book, "whole", F.explode(bases(F.col("whole"))).alias("word"))
    wanted = tried.select(book, "word").distinct()
    # Words are joined before they are made distinct: few of them are wanted
    words = texts.select(book, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    known = words.join(wanted, [book, "word"], "left_semi").distinct()
    joins = tried.join(known, [book, "word"]).select(book, "whole").distinct().withColumn("one", F.lit(True))
    decided = breaks.join(joins, [book, "whole"], "left")
    word = F.concat("left", F.when(F.col("one"), F.lit("")).otherwise(F.lit("-")), "right")
    return decided.groupBy(book, block).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))), lambda x: x["w"]).alias("fixes"))


def _mended(text: Column, fixes: Column) -> Column:
    return F.array_join(F.zip_with(F.split(text, WRAP, -1), fixes, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def dehyphenate(texts: DataFrame, book: str = "book_id", block: str = "block_no") -> DataFrame:
    """book, block, text: broken words become one word if the book has it or a base of it, else keep the hyphen; the white
    space goes. Only candidates of broken words are joined with the vocabulary; halves of 1 or 2 letters keep the hyphen."""
    fixed = texts.join(_fixes(texts, book, block), [book, block], "left")
    return fixed.withColumn("text", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(_mended(F.col("text"), F.col("fixes")))).drop("fixes")


def dehyphenate_chapters(chapters: DataFrame, book: str = "book_id", chapter: str = "chapter_no", blocks: str = "blocks") -> DataFrame:
    """chapters(book, chapter, blocks array<struct<..., text, ...>>) with the texts of all blocks as dehyphenate has them, by the
    words of the whole book; blocks keep their places and all else. Null blocks stay null. Chapters, which are read several
    times, are written, and stay whole: only what stands for broken words is brought to them."""
    chapters = written(chapters)
    flat = chapters.select(book, chapter, F.posexplode(F.transform(blocks, lambda b: b["text"])).alias("_pos", "text"))
    fixes = _fixes(flat.select(book, F.struct(F.col(chapter).alias("c"), F.col("_pos").alias("p")).alias("_key"), "text"), book, "_key")
    found = fixes.groupBy(book, F.col("_key.c").alias(chapter)).agg(F.array_sort(F.collect_list(F.struct(F.col("_key.p").alias("p"), "fixes"))).alias("_found"))
    # An entry for each block up to the last with a broken word, null where it has none
    none = F.lit(None).cast("array<string>")
    gap = lambda x, i: x["p"] - F.when(i == 0, -1).otherwise(F.get("_found", i - 1)["p"]) - 1
    aligned = F.flatten(F.transform("_found", lambda x, i: F.concat(F.array_repeat(none, gap(x, i)), F.array(x["fixes"]))))
    mended = F.zip_with(blocks, aligned, lambda b, f: F.when(f.isNull(), b).otherwise(b.withField("text", _mended(b["text"], f))))
    return chapters.join(found, [book, chapter], "left").withColumn(blocks, F.when(F.col("_found").isNull(), F.col(blocks)).otherwise(mended)).drop("_found")
