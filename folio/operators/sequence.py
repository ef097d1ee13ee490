"""Numbers in names, and whether a group of names is a numbered sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import js
from folio.functions.text import without_extension

# Spellings of each label
LABELS = {
    "Chapter": ["chapter", "chapters", "chap", "chaps", "ch"],
    "Part": ["part", "parts", "pt"],
    "Section": ["section", "sections", "sect", "sects", "sec"],
    "Page": ["page", "pages", "pg"],
    "Volume": ["volume", "volumes", "vol"],
    "Episode": ["episode", "episodes", "ep", "eps"],
    "Book": ["book", "books"],
    "Unit": ["unit", "units"],
    "Lesson": ["lesson", "lessons"],
    "No.": ["no", "nos", "num"],
}
_SPELLED = "|".join(sorted((w for ws in LABELS.values() for w in ws), key=lambda w: (-len(w), w)))
KEYWORD = rf"(?i){js.START}({_SPELLED}){js.END}\.?{js.WS}*[-_#]?{js.WS}*([0-9]{{1,6}})"
FIRST_INTEGER = r"(?<![0-9,.])([0-9]{1,6})(?![0-9,.][0-9])"
LEAST, MOST_RANGE, SHARE = 3, 5000, 0.6


def extract_number(name: Column) -> Column:
    """struct(num int, label string): the number after a known word, else the first that stands alone."""
    base = without_extension(name)
    word = F.lower(F.regexp_extract(base, KEYWORD, 1))
    label = F.create_map(*[F.lit(x) for k, ws in LABELS.items() for w in ws for x in (w, k)])
    by_word, alone = F.regexp_extract(base, KEYWORD, 2), F.regexp_extract(base, FIRST_INTEGER, 1)
    return F.struct(F.when(word != "", by_word).otherwise(F.nullif(alone, F.lit(""))).cast("int").alias("num"), F.when(word != "", F.try_element_at(label, word)).alias("label"))


def chapter_title(name: Column) -> Column:
    found = extract_number(name)
    base = without_extension(name)
    clean = js.squeeze(F.regexp_replace(F.regexp_replace(base, rf"{js.WS}*\([^)]*\){js.WS}*", " "), "[_-]+", " "))
    return F.when(found["label"].isNotNull() & found["num"].isNotNull(), F.concat_ws(" ", found["label"], found["num"].cast("string"))).when(clean == "", base).otherwise(clean)


def expand_pattern(pattern: Column, position: Column, name: Column) -> Column:
    number = F.coalesce(extract_number(name)["num"], position).cast("string")
    return js.trim(F.replace(F.replace(pattern, F.lit("{num}"), number), F.lit("{n}"), position.cast("string")))


def title_key(title: Column) -> Column:
    """A number to sort titles by: volume * 1e6 + chapter, decimals allowed; null without a number."""
    ch = F.regexp_extract(title, rf"(?i){js.START}(?:ch(?:apter)?|ep(?:isode)?|part)\.?{js.WS}*#?{js.WS}*([0-9]+(?:\.[0-9]+)?)", 1)
    vol = F.regexp_extract(title, rf"(?i){js.START}(?:vol(?:ume)?|book)\.?{js.WS}*#?{js.WS}*([0-9]+)", 1)
    bare = F.regexp_extract(title, r"(?:^|[^0-9.])([0-9]+\.[0-9]+)(?![0-9.])", 1)
    volume = F.coalesce(F.nullif(vol, F.lit("")).cast("double"), F.lit(0.0)) * 1e6
    return F.when(ch != "", volume + F.nullif(ch, F.lit("")).cast("double")).when(bare != "", F.nullif(bare, F.lit("")).cast("double")).otherwise(extract_number(F.concat(title, F.lit(".x")))["num"].cast("double"))


def analyze(numbers: DataFrame, by: str, position: str, num: str = "num", label: str = "label") -> DataFrame:
    """by, has_order, missing, duplicates, label, min, max: one row a group. Counts are summed before the groups meet, so
    a group holds its distinct numbers (5000 at most matter) and labels only."""
    per = numbers.groupBy(by, num).agg(F.count("*").alias("n"))
    sums = per.groupBy(by).agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col(num).isNotNull(), F.col("n")).otherwise(0)).alias("present"), F.count(num).alias("distinct"),
        F.min(num).alias("min"), F.max(num).alias("max"),
    )
    span = F.col("max") - F.col("min") + 1
    ordered = (F.col("present") >= LEAST) & (F.col("max") > F.col("min")) & (span <= MOST_RANGE) & (F.col("distinct") >= SHARE * span) & (F.col("present") >= SHARE * F.col("all"))
    good = sums.where(ordered)
    used = per.join(good.select(by), by).where(F.col(num).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(num)).alias("used"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col(num)))).alias("duplicates"))
    labels = numbers.where(F.col(label).isNotNull()).groupBy(by, label).agg(F.count("*").alias("n"), F.min(position).alias("first")).groupBy(by).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("label"))
    found = good.join(used, by).join(labels, by, "left").select(by, F.lit(True).alias("has_order"), F.array_except(F.sequence("min", "max"), "used").alias("missing"), "duplicates", "label", "min", "max")
    empty = F.array().cast("array<int>")
    rest = sums.where(~F.coalesce(ordered, F.lit(False))).select(by, F.lit(False).alias("has_order"), empty.alias("missing"), empty.alias("duplicates"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("min"), F.lit(None).cast("int").alias("max"))
    return found.unionByName(rest)
