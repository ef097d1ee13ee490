"""A library of converted books as tables: outputs without their texts, texts beside them, the queue, and the cache of posts.

Tables are rewritten as a whole by what these functions return; nothing here writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import js
from folio.operators.retention import chapters_bytes

CACHE_VERSION = 1
CACHE_DAYS = 30


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records(id, ..., chapters) -> (outputs with has_chapters and chapters_size in place of chapters, texts(id, chapters)).
    Without chapters the columns has_chapters and chapters_size of records count, if there are any."""
    has = F.coalesce(F.size("chapters") > 0, F.lit(False))
    known = lambda name, none: F.coalesce(F.col(name), F.lit(none)) if name in records.columns else F.lit(none)
    outputs = records.withColumns({
        "has_chapters": F.when(has, True).otherwise(known("has_chapters", False)),
        "chapters_size": F.when(has, chapters_bytes(F.col("chapters"))).otherwise(known("chapters_size", 0)).cast("long"),
    }).drop("chapters")
    return outputs, records.where(has).select("id", "chapters")


def upsert_outputs(outputs: DataFrame, texts: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with records(id, ..., chapters; each id once) put in: new rows replace those of their id; a record
    without chapters keeps the old text, and says so."""
    new, new_texts = split_records(records)
    old = outputs.select("id", F.col("has_chapters").alias("_h"), F.col("chapters_size").alias("_s"))
    carried = F.coalesce("_h", F.lit(False)) & ~F.col("_given")
    given = new_texts.select("id", F.lit(True).alias("_g"))
    merged = new.join(given, "id", "left").withColumn("_given", F.coalesce("_g", F.lit(False))).join(old, "id", "left")
    merged = merged.withColumns({"has_chapters": F.when(carried, True).otherwise(F.col("has_chapters")), "chapters_size": F.when(carried, F.coalesce("_s", F.lit(0))).otherwise(F.col("chapters_size"))})
    kept = outputs.join(new.select("id"), "id", "left_anti")
    return kept.unionByName(merged.select(*outputs.columns)), texts.join(new_texts.select("id"), "id", "left_anti").unionByName(new_texts)


def delete_outputs(outputs: DataFrame, texts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids of gone."""
    ids = gone.select("id").distinct()
    return outputs.join(ids, "id", "left_anti"), texts.join(ids, "id", "left_anti")


def newest_first(rows: DataFrame, at: str = "created_at", id_: str = "id") -> DataFrame:
    """Listings: the newest first, ties by id."""
    return rows.orderBy(F.desc(at), id_)


def profiles(rows: DataFrame) -> DataFrame:
    """Saved rule sets(id, name, config, updated_at), the last changed first; those without a config aren't shown."""
    return newest_first(rows.where(F.col("config").isNotNull()), "updated_at")


def texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the ids of wanted alone: others are neither shuffled nor sent on."""
    return texts.join(wanted.select("id").distinct(), "id", "left_semi")


def queue_rows(items: DataFrame) -> DataFrame:
    """items(id, name, last_modified, content, title) as they are stored: a blank title is none, others are trimmed."""
    return items.select("id", "name", "last_modified", "content", F.nullif(js.trim(F.col("title")), F.lit("")).alias("title"))


def restored_queue(rows: DataFrame) -> DataFrame:
    """Stored rows as items again: those without content go. A missing id is made from what the row has, so that it is the
    same whenever it is computed; equal rows without ids are told apart by `position`, where rows have it."""
    of = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("position", "name", "last_modified", "title") if c in rows.columns]
    made = F.coalesce(F.nullif("id", F.lit("")), F.sha2(F.concat_ws("\x1f", *of, F.sha2("content", 256)), 256))
    return rows.where(F.col("content").isNotNull()).withColumn("id", made)


def cache_rows(results: DataFrame, now: Column) -> DataFrame:
    """results(id, ok, title, html, published_at) to be stored: successes only, with version and time."""
    return results.where("ok").select("id", F.lit(CACHE_VERSION).alias("v"), "title", "html", "published_at", now.alias("saved_at"))


def _readable() -> Column:
    return F.coalesce((F.col("v") == CACHE_VERSION) & F.col("title").isNotNull() & F.col("html").isNotNull(), F.lit(False))


def cached(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """The readable rows of the wanted ids."""
    return cache.where(_readable()).join(wanted.select("id").distinct(), "id", "left_semi")


def pruned_cache(cache: DataFrame, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """cache without rows that are older than `days` or can't be read."""
    return cache.where(_readable() & F.coalesce(F.col("saved_at") >= now - F.expr(f"interval {days} days"), F.lit(False)))


def string_items(json_list: Column) -> Column:
    """The strings of a list in JSON, in their order; empty if it is no list. Items of other kinds go."""
    raw = F.from_json(json_list, "array<variant>")
    return F.coalesce(F.filter(F.transform(raw, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))), lambda s: s.isNotNull()), F.array().cast("array<string>"))


def shapes(rows: DataFrame, endpoint: str, body: str) -> DataFrame:
    """endpoint, keys: the distinct names at the top of the JSON objects of each endpoint, sorted; values are never looked at."""
    named = rows.select(endpoint, F.explode(F.json_object_keys(body)).alias("k"))
    return named.groupBy(endpoint).agg(F.sort_array(F.collect_set("k")).alias("keys"))
