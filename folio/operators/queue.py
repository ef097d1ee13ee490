"""A queue of files and chapters: its order, moves of selected rows, names, gaps between neighbours, and results put back in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import js
from folio.functions.text import MAX_FILENAME, natural_key, sanitize_filename
from folio.operators.sequence import extract_number

MAX_INLINE_GAP = 25


def auto_order(items: DataFrame, name: str = "name", position: str = "position") -> DataFrame:
    """items with `place`, a sort key: those with a number first, by it; then by natural name; then by position. A total
    order, so the outcome depends on no sort algorithm."""
    number = extract_number(F.col(name))["num"]
    return items.withColumn("place", F.struct(number.isNull().alias("unnumbered"), number.alias("num"), natural_key(F.col(name)).alias("name"), F.col(position).alias("position")))


def move_group(items: DataFrame, moves: DataFrame, by: str = "list_id") -> DataFrame:
    """items(by, id, position) with new positions from 0 after moves(by, selected array<id>, active, over): one drag for each list.

    The active item, or with more selected than it all selected ones in their order, goes to the place of `over`: before
    it when dragged up, behind it when dragged down. Unknown ids, and drops onto one of the group, change nothing."""
    own = Window.partitionBy(by)
    here = items.join(moves, by, "left")
    at = lambda c: F.max(F.when(F.col("id") == F.col(c), F.col("position"))).over(own)
    group = F.coalesce(F.array_contains("selected", F.col("active")) & (F.size("selected") > 1), F.lit(False))
    moving = F.when(group, F.array_contains("selected", F.col("id"))).otherwise(F.col("id") == F.col("active"))
    seen = here.withColumns({"_from": at("active"), "_to": at("over"), "_moving": F.coalesce(moving, F.lit(False))})
    onto = F.max(F.when(F.col("id") == F.col("over"), F.col("_moving"))).over(own)
    valid = F.coalesce(F.col("_from").isNotNull() & F.col("_to").isNotNull() & ~onto, F.lit(False))
    down = F.col("_from") < F.col("_to")
    # Rows that stay keep whole places; the moved ones go half a place before or behind
    place = F.when(valid & F.col("_moving"), F.col("_to") + F.when(down, 0.5).otherwise(-0.5)).otherwise(F.col("position").cast("double"))
    order = Window.partitionBy(by).orderBy("_place", "position")
    return seen.withColumn("_place", place).select(*[c for c in items.columns if c != "position"], (F.row_number().over(order) - 1).alias("position"))


def range_ids(ids: Column, a: Column, b: Column) -> Column:
    """The ids of a list from place a to place b, both included, whichever comes first."""
    lo, hi = F.greatest(F.least(a, b), F.lit(0)), F.greatest(a, b)
    return F.slice(ids, lo + 1, F.greatest(hi - lo + 1, F.lit(0)))


def added_selection(selected: Column, more: Column) -> Column:
    """Both, each once, the old ones first."""
    return F.array_union(selected, more)


def between(rows: DataFrame, position: str, first: int, last: int) -> DataFrame:
    """Rows at the positions first to last, both included."""
    return rows.where(F.col(position).between(first, last))


def add_new(existing: DataFrame, added: DataFrame, key: list[str], position: str = "position") -> DataFrame:
    """added with `is_new`: neither there nor added before, by a composite key. Null parts of keys count as equal."""
    both = existing.select(*key, F.lit(0).alias("_src"), F.lit(0).cast("long").alias("_at")).unionByName(added.select(*key, F.lit(1).alias("_src"), F.col(position).cast("long").alias("_at")))
    first = both.groupBy(*key).agg(F.min(F.struct("_src", "_at")).alias("_first"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    joined = added.alias("a").join(first.alias("f"), same)
    return joined.select("a.*", ((F.col("f._first._src") == 1) & (F.col("f._first._at") == F.col(f"a.{position}"))).alias("is_new"))


def inline_gaps(rows: DataFrame, by: str, position: str, num: str, most: int = MAX_INLINE_GAP) -> DataFrame:
    """by, position, missing: the whole numbers between a row's number and the next one's, if there are 1 to `most`."""
    w = Window.partitionBy(by).orderBy(position)
    seen = rows.withColumn("_next", F.lead(num).over(w)).where((F.col("_next") - F.col(num)).between(2, most + 1))
    return seen.select(by, position, F.sequence(F.col(num) + 1, F.col("_next") - 1).alias("missing"))


def ordered_results(results: DataFrame, order: DataFrame, by: str = "list_id") -> DataFrame:
    """results(by, id, position, ok) with `place` from 1: successes by order(by, id, place), then failures as they were."""
    placed = results.join(order.select(by, "id", F.col("place").alias("_o")), [by, "id"], "left")
    w = Window.partitionBy(by).orderBy(~F.col("ok"), F.when(F.col("ok"), F.col("_o")).asc_nulls_last(), "position")
    return placed.select(*results.columns, F.row_number().over(w).alias("place"))


def book_filename(title: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """`title.epub`, or `title (first-last).epub`; the title gives way to the range."""
    suffix = F.lit("") if first is None else F.coalesce(F.concat(F.lit(" ("), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")")), F.lit(""))
    stem = F.regexp_replace(F.left(sanitize_filename(title), F.lit(MAX_FILENAME) - F.length(suffix)), rf"[.{js.WS_CHARS}]+\z", "")
    return F.concat(F.when(stem == "", "untitled").otherwise(stem), suffix, F.lit(".epub"))


def clean_title(title: Column, book: Column) -> Column:
    """title without the book's name before it, if that ends at a word and something is left."""
    t, name = js.squeeze(title), F.coalesce(js.squeeze(book), F.lit(""))
    tail = F.substring(t, F.length(name) + 1, F.length(t))
    rest = js.trim(F.regexp_replace(tail, rf"^{js.WS}*[-–—:|,]{js.WS}*", ""))
    fits = (name != "") & F.lower(t).startswith(F.lower(name)) & tail.rlike(rf"^(?:{js.WS}|[-–—:|,])")
    return F.when(fits & (rest != ""), rest).otherwise(t)


def wait_text(ms: Column) -> Column:
    """Milliseconds as m:ss, rounded up."""
    s = F.ceil(ms / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
