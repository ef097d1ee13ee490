"""Exact dedup by deterministic block naming.

Texts without white space are cut into blocks of fixed size. Equal blocks get one integer name, the smallest number that
a block of this content has; adjacent names are paired and pairs named likewise, level by level, until each document has
one name. Two documents of as many blocks have the same last name exactly if their texts are equal: names are given by
comparing contents, never by a hash, so there are no collisions.

Blocks of the first level are named where one shuffle by content brings equal ones together. Hashes of blocks are counted
first (partial sums, 8 bytes a row); the few that occur more than `hot` times, at most MAX_HOT by that bound, are spread
over SALTS tasks, and only one row a salt meets again. Later levels hold a few integers a row; their names are written
and joined back with plain equi-joins, whose large partitions Spark splits.

Defined results: null text counts as empty; empty texts are one group; of equal texts the one with the most code points
in the original, then the smallest doc_id (null last) stays; rows alike in both have one doc_id and are ranked by row, so
exactly one row a group has kept = true; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import cut, table

BLOCK_BYTES = 4096
MAX_HOT = 4096
SALTS = 64
_SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """text without [\\x20\\x09-\\x0D]; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for s in _SPACES:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def _blocks(docs: DataFrame, size: int, row: str | None) -> DataFrame:
    """A row for each block: _row, n_blocks, _pos, block; the first block also has the document's own columns."""
    rows = docs.select("doc_id", (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("_chars"), normalised(F.col("text")).cast("binary").alias("_norm"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_norm") / size)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("_norm"), i * size + 1, F.lit(size)))
    first = rows.select("_row", "doc_id", "_chars", F.sha2("_norm", 256).alias("text_sha256"), count.alias("n_blocks"), F.posexplode(cuts).alias("_pos", "block"))
    own = {c: F.when(F.col("_pos") == 0, F.col(c)) for c in ("doc_id", "_chars", "text_sha256")}
    return first.withColumns(own)


def _first_names(docs: DataFrame, size: int, hot: int, row: str | None) -> DataFrame:
    blocks = _blocks(docs, size, row)
    number = F.struct("_row", "_pos")
    hashed = blocks.select(F.xxhash64("block").alias("_h")).groupBy("_h").agg(F.count("*").alias("_n"))
    often = hashed.where(F.col("_n") > hot).orderBy(F.desc("_n"), "_h").limit(MAX_HOT).select("_h").collect()
    hashes = [r["_h"] for r in often]
    is_hot = F.xxhash64("block").isin(hashes) if hashes else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.hash("_row", "_pos"), F.lit(SALTS))).otherwise(0)
    named = blocks.withColumns({"_hot": is_hot, "_salt": salt}).withColumn("_name", F.min(number).over(Window.partitionBy("block", "_salt")))
    lead = F.col("_hot") & (F.col("_name") == number)
    return cut(named.select("_row", "doc_id", "_chars", "text_sha256", "n_blocks", "_pos", "_name", F.when(lead, F.col("block")).alias("_lead")))


def identities(docs: DataFrame, size: int = BLOCK_BYTES, hot: int = 1000, row: str | None = None) -> DataFrame:
    """_row, doc_id, _chars, text_sha256, n_blocks, _name: one row a document, alike in the last two if texts are equal."""
    level = _first_names(docs, size, hot, row)
    # Of each hot content, the names that its salts gave: SALTS rows a content at most
    leads = level.where("_lead is not null").select("_lead", "_name")
    best = leads.groupBy("_lead").agg(F.min("_name").alias("_to"))
    fix = leads.join(best, "_lead").where("_name != _to").select("_name", "_to")
    level = level.drop("_lead").join(F.broadcast(fix), "_name", "left").withColumn("_name", F.coalesce("_to", "_name")).drop("_to")
    rows = level.where("_pos = 0").select("_row", "doc_id", "_chars", "text_sha256", "n_blocks", "_name")
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    if longest == 1:
        return rows
    names = level.where("n_blocks > 1").select("_row", "n_blocks", "_pos", "_name")
    done = []
    left = longest
    step = 1
    while left > 1:
        # Neighbours meet; a last name without a neighbour is paired with none
        pair = names.groupBy("_row", "n_blocks", F.expr("_pos div 2").alias("_pos")).agg(F.min(F.when(F.col("_pos") % 2 == 0, F.col("_name"))).alias("_a"), F.min(F.when(F.col("_pos") % 2 == 1, F.col("_name"))).alias("_b"))
        pair = cut(pair.withColumn("_b", F.coalesce("_b", F.struct(F.lit(-1).cast("long").alias("_row"), F.lit(-1).alias("_pos")))))
        found = cut(pair.groupBy("_a", "_b").agg(F.min(F.struct("_row", F.col("_pos").cast("int").alias("_pos"))).alias("_name")))
        names = pair.join(found, ["_a", "_b"]).select("_row", "n_blocks", F.col("_pos").cast("int").alias("_pos"), "_name")
        step *= 2
        left = -(-left // 2)
        done.append(names.where(F.col("n_blocks") <= step).select("_row", "_name"))
        names = names.where(F.col("n_blocks") > step)
    last = done[0]
    for d in done[1:]:
        last = last.unionByName(d)
    short = rows.where("n_blocks = 1")
    long = rows.where("n_blocks > 1").drop("_name").join(last, "_row")
    return short.unionByName(long)


def dedup(docs: DataFrame, size: int = BLOCK_BYTES, hot: int = 1000, row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and _row for every row of docs(doc_id, text); _row is the value of
    the column named by `row`, which must be unique, or else a number."""
    rows = cut(identities(docs, size, hot, row))
    rank = F.struct((-F.col("_chars")).alias("_c"), F.col("doc_id").isNull().alias("_n"), F.col("doc_id").alias("_d"), F.col("_row").alias("_r"))
    groups = cut(rows.groupBy("n_blocks", "_name").agg(F.count("*").alias("group_size"), F.min(rank).alias("_best")))
    out = rows.join(groups, ["n_blocks", "_name"])
    return out.select("doc_id", F.col("_best._d").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._r")).alias("kept"), "text_sha256", "_row")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    row = "_folio_row_" + "_" * max(map(len, docs.columns))  # no other column has this name
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    stay = dedup(numbered, row=row).where("kept").select(F.col("_row").alias(row))
    return numbered.join(stay, row, "left_semi").drop(row)


def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("_row")


SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256, row_number() OVER () AS r
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, r)
"""
