"""Queries of the engine's own operators over the test tables, and SQL that says the same independently.

Noise that the tables lack (ligatures, broken words, bullets, tags) is put in by the query; the SQL states what must come
out without it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import islands, joins, layout, markup, ordering, palette, policy, retention, rules, sequence, sheets, vocabulary
from folio.operators.folds import ordered_fold
from folio.sources import feeds, packages
from folio.streaming import policy as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return docs


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books, turns as pages whose first line is the role."""
    c = read(spark, sf_dir, "conversations")
    lines = F.split(F.concat(F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text")), "\n", -1)
    return c.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_no"), F.posexplode(lines).alias("line_no", "text"))


def page_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("book_id").agg(F.countDistinct("page_no").alias("n_pages"))


# Text


@query("SELECT doc_id, md5(text) AS h FROM documents")
def q_normalize_chars(spark, sf_dir):
    noisy = F.regexp_replace(F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("ff"), F.lit("ﬀ")), " ", " ​")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_characters(noisy)).alias("h"))


@query("""
SELECT doc_id, trim(left(trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '[\\\\/:*?"<>|]', ' ', 'g'), '\\s+', ' ', 'g'), '. '), 120), '. ') AS name,
  CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN (n_chars + 512) // 1024 || ' KB' WHEN n_chars < 1073741824 THEN printf('%.1f MB', floor(n_chars / 1048576.0 * 10 + 0.5) / 10)
    ELSE printf('%.2f GB', floor(n_chars / 1073741824.0 * 100 + 0.5) / 100) END AS size,
  printf('%.1f MB', floor((1048576 + n_chars * 977) / 1048576.0 * 10 + 0.5) / 10) AS larger
FROM documents""")
def q_sanitize_name(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    name = text.sanitize_filename(F.element_at(F.split("text", "\n", -1), 1))
    return d.select("doc_id", F.when(name == "untitled", "").otherwise(name).alias("name"), text.format_bytes(F.col("n_chars")).alias("size"), text.format_bytes(F.col("n_chars") * 977 + 1048576).alias("larger"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM documents")
def q_escape_html(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.escape_html(F.col("text")).alias("html"))


@query("""
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, count(*) AS lines, count(DISTINCT lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')))) AS keys FROM l GROUP BY source""")
def q_header_keys(spark, sf_dir):
    return doc_lines(spark, sf_dir).groupBy("source").agg(F.count("*").alias("lines"), F.countDistinct(text.header_key(F.col("text"))).alias("keys"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '* * *' WHEN 1 THEN '◇◇◇' WHEN 2 THEN '*' WHEN 3 THEN '...' WHEN 4 THEN '◆' ELSE '-----------' END AS t FROM documents)
SELECT doc_id, doc_id % 6 IN (0, 1, 4) AS is_break FROM d""")
def q_scene_breaks(spark, sf_dir):
    k = F.col("doc_id") % 6
    line = F.when(k == 0, "* * *").when(k == 1, "◇◇◇").when(k == 2, "*").when(k == 3, "...").when(k == 4, "◆").otherwise("-----------")
    return read(spark, sf_dir, "documents").select("doc_id", text.is_scene_break(line).alias("is_break"))


@query("""
WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents)
SELECT source, count(DISTINCT word) AS words, min(word) AS first_word FROM w GROUP BY source""")
def q_vocabulary(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumnRenamed("source", "book_id")
    return vocabulary.vocabulary(d).groupBy(F.col("book_id").alias("source")).agg(F.count("*").alias("words"), F.min("word").alias("first_word"))


@query("""
WITH d AS (SELECT source, doc_id, regexp_extract(text, '^(\\p{L}+)', 1) AS w FROM documents)
SELECT doc_id, CASE WHEN length(w) >= 6 THEN left(w, 3) || lower(substr(w, 4)) ELSE '' END AS joined FROM d""")
def q_dehyphenate(spark, sf_dir):
    """A long first word is broken; the book has it elsewhere (its whole text follows), so it is joined again."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("block_no"), "text")
    first = F.regexp_extract("text", r"^(\p{L}+)", 1)
    broken = F.concat(F.substring(first, 1, 3), F.lit("- "), F.lower(F.substring(first, F.lit(4), F.length(first))), F.lit(" "), F.col("text"))
    noisy = d.where(F.length(first) >= 6).withColumn("text", broken)
    fixed = vocabulary.dehyphenate(noisy).select("block_no", F.regexp_extract("text", r"^(\p{L}+)", 1).alias("joined"))
    return d.select("block_no").join(fixed, "block_no", "left").select(F.col("block_no").alias("doc_id"), F.coalesce("joined", F.lit("")).alias("joined"))


# Layout


_TURNS = """
WITH c AS (SELECT conv_id AS book_id, turn AS page_no, string_split(role || ' ' || turn || chr(10) || text, chr(10)) AS ls FROM conversations),
l AS (SELECT book_id, page_no, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS line_no, len(ls) AS n FROM c),
e AS (SELECT *, line_no < 2 OR line_no >= n - 2 AS edge, lower(trim(regexp_replace(regexp_replace(t, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))) AS key FROM l),
p AS (SELECT book_id, count(DISTINCT page_no) AS n_pages FROM l GROUP BY 1),
h AS (SELECT book_id, key, count(DISTINCT page_no) AS pages FROM e WHERE edge AND key <> '' GROUP BY 1, 2),
r AS (SELECT book_id, key, pages FROM h JOIN p USING (book_id) WHERE pages >= 3 AND pages > 0.5 * n_pages)
"""


@query(_TURNS + "SELECT * FROM r")
def q_running_heads(spark, sf_dir):
    lines = turns(spark, sf_dir)
    return layout.running_heads(lines, page_counts(lines))


@query(_TURNS + """
SELECT book_id, count(*) AS kept, md5(string_agg(t, chr(10) ORDER BY page_no, line_no)) AS h FROM e LEFT JOIN r USING (book_id, key)
WHERE NOT (edge AND (r.pages IS NOT NULL OR regexp_full_match(t, '\\s*[0-9]+\\s*'))) GROUP BY book_id""")
def q_strip_heads(spark, sf_dir):
    lines = turns(spark, sf_dir)
    kept = layout.strip_running_heads(lines, page_counts(lines))
    return kept.groupBy("book_id").agg(F.count("*").alias("kept"), F.md5(islands.joined_text(F.col("text"), F.struct("page_no", "line_no"), "\n")).alias("h"))


@query("""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
k AS (SELECT source, doc_id, lower(trim(regexp_replace(regexp_replace(t, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))) AS key FROM l),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT source, key, count(DISTINCT doc_id) AS docs FROM k JOIN n USING (source) WHERE key <> '' GROUP BY source, key, n.n HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) > 0.1 * n.n""")
def q_source_boilerplate(spark, sf_dir):
    keyed = doc_lines(spark, sf_dir).withColumn("key", text.header_key(F.col("text"))).where("key <> ''")
    docs = keyed.select("source", "key", "doc_id").distinct().groupBy("source", "key").agg(F.count("*").alias("docs"))
    n = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return docs.where("docs >= 3").join(n, "source").where("docs > 0.1 * n").drop("n")


def _geometry(lines: DataFrame) -> DataFrame:
    """Steps of 10, of 30 after a line whose length is a multiple of 3; every fifth line has a bullet."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    step = F.when(F.length(F.lag("text").over(w)) % 3 == 0, 30).otherwise(10)
    drawn = lines.withColumn("_step", step).withColumn("y", (-F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("double")).withColumn("height", F.lit(10.0))
    return drawn.select("doc_id", F.lit(1).alias("page_no"), "line_no", "y", "height", F.when(F.col("line_no") % 5 == 4, F.concat(F.lit("• "), F.col("text"))).otherwise(F.col("text")).alias("text"))


@query("""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS line_no FROM s),
p AS (SELECT *, line_no % 5 = 4 AS bullet, lag(t) OVER w AS pt, lag(line_no % 5 = 4) OVER w AS pb FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
f AS (SELECT *, CASE WHEN pt IS NULL OR bullet OR length(pt) % 3 = 0 OR (pb AND NOT regexp_matches(t, '^[a-z]')) THEN 1 ELSE 0 END AS st FROM p),
b AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM f),
g AS (SELECT doc_id, block_no, count(*) AS n_lines, bool_or(bullet AND st = 1) AS li, string_agg(t, ' ' ORDER BY line_no) AS t FROM b GROUP BY 1, 2)
SELECT doc_id, count(*) AS blocks, sum(CASE WHEN li THEN 1 ELSE 0 END)::BIGINT AS bullets, max(n_lines) AS longest,
  md5(string_agg(CASE WHEN li THEN regexp_replace(t, '^\\s+|\\s+$', '', 'g') ELSE t END, chr(10) ORDER BY block_no)) AS h FROM g GROUP BY doc_id""")
def q_blocks(spark, sf_dir):
    blocks = layout.assemble_blocks(_geometry(doc_lines(spark, sf_dir)))
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("type") == "li").alias("bullets"), F.max("n_lines").alias("longest"), F.md5(islands.joined_text(F.col("text"), F.col("block_no"), "\n")).alias("h"))


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN rtrim(text, '.') ELSE lower(left(text, 1)) || substr(text, 2) END AS t FROM conversations),
p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS pt FROM c),
s AS (SELECT *, CASE WHEN pt IS NULL OR regexp_matches(pt, '[.!?…"”’'']\\s*$') OR right(pt, 1) = ']' OR NOT regexp_matches(t, '^\\p{Ll}') THEN 1 ELSE 0 END AS st FROM p),
i AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM s),
b AS (SELECT conv_id, block, string_agg(t, ' ' ORDER BY turn) AS t FROM i GROUP BY 1, 2)
SELECT conv_id, count(*) AS blocks, md5(string_agg(t, chr(10) ORDER BY block)) AS h FROM b GROUP BY conv_id""")
def q_stitch(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    t = F.when(F.col("turn") % 2 == 0, F.rtrim(F.col("text"), F.lit("."))).otherwise(F.concat(F.lower(F.left("text", F.lit(1))), F.substring("text", F.lit(2), F.length("text"))))
    blocks = c.select("conv_id", F.col("turn").alias("page_no"), F.lit(1).alias("block_no"), F.lit("p").alias("type"), t.alias("text"))
    return layout.stitch_pages(blocks, "conv_id").groupBy("conv_id").agg(F.count("*").alias("blocks"), F.md5(islands.joined_text(F.col("text"), F.col("block_no"), "\n")).alias("h"))


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(w), 8)) AS k, w FROM d)
SELECT doc_id, k // 400 + 1 AS page_no, sum(least(8, len(w) - k))::BIGINT AS words, count(*) AS lines, md5(string_agg(list_aggregate(w[k + 1 : k + 8], 'string_agg', ' '), chr(10) ORDER BY k)) AS text FROM l GROUP BY 1, 2""")
def q_glyph_lines(spark, sf_dir):
    """The words of each document set eight to a line, fifty lines to a page, in shuffled order of arrival."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("i", "w"))
    x, y = (F.col("i") % 8) * 1000.0, -20.0 * F.floor(F.col("i") / 8)
    glyphs = d.select(F.col("doc_id").cast("string").alias("file_id"), (F.floor(F.col("i") / 400) + 1).cast("int").alias("page_no"), F.pmod(F.xxhash64("doc_id", "i"), F.lit(1 << 30)).cast("int").alias("glyph_no"), F.col("w").alias("str"), (F.length("w") * 5.0).alias("width"), F.lit(10.0).alias("height"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), x, y.cast("double")).alias("transform"))
    lines = layout.reconstruct_lines(glyphs)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda l: l["text"]), "\n")
    return lines.groupBy(F.col("file_id").cast("long").alias("doc_id"), F.col("page_no").cast("long").alias("page_no")).agg(F.sum(F.size(F.split("text", " "))).alias("words"), F.count("*").alias("lines"), F.md5(whole).alias("text"))


# Sequences


@query("""
WITH n AS (SELECT l_orderkey AS g, CAST(l_linenumber + (l_partkey % 3) AS INT) AS num, l_linenumber AS pos, CASE WHEN l_orderkey % 3 = 0 AND (l_linenumber - min(l_linenumber) OVER (PARTITION BY l_orderkey)) % 2 = 0 THEN 'Part' ELSE 'Chapter' END AS label FROM lineitem),
lab AS (SELECT g, arg_max(label, k * 1000 - f) AS label FROM (SELECT g, label, count(*) AS k, min(pos) AS f FROM n GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT g, count(*) AS present, count(DISTINCT num) AS d, min(num) AS mn, max(num) AS mx FROM n GROUP BY g),
o AS (SELECT *, present >= 3 AND mx > mn AND mx - mn + 1 <= 5000 AND d >= 0.6 * (mx - mn + 1) AS ok FROM s),
c AS (SELECT g, num, count(*) AS k FROM n GROUP BY 1, 2)
SELECT o.g AS orderkey, ok AS has_order, CASE WHEN ok THEN mx - mn + 1 - d ELSE 0 END::BIGINT AS n_missing,
  CASE WHEN ok THEN (SELECT count(*) FROM c WHERE c.g = o.g AND k > 1) ELSE 0 END::BIGINT AS n_duplicates, CASE WHEN ok THEN (SELECT array_to_string(list_filter(range(mn, mx + 1), lambda i: NOT list_contains(list(c.num), i)), ',') FROM c WHERE c.g = o.g) ELSE '' END AS missing,
  CASE WHEN ok THEN coalesce((SELECT string_agg(num, ',' ORDER BY num) FROM c WHERE c.g = o.g AND k > 1), '') ELSE '' END AS duplicates, CASE WHEN ok THEN (SELECT label FROM lab WHERE lab.g = o.g) END AS label, CASE WHEN ok THEN mn END AS lo, CASE WHEN ok THEN mx END AS hi
FROM o""")
def q_sequence(spark, sf_dir):
    # Each third order's lines are parts and chapters by turns, of which the first seen wins where they are as many, and parts else
    first = F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))
    label = F.when((F.col("l_orderkey") % 3 == 0) & ((F.col("l_linenumber") - first) % 2 == 0), "Part").otherwise("Chapter")
    n = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("position"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int").alias("num"), label.alias("label"))
    found = sequence.analyze(n, "l_orderkey", "position")
    spelled = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return found.select(F.col("l_orderkey").alias("orderkey"), "has_order", F.size("missing").cast("long").alias("n_missing"), F.size("duplicates").cast("long").alias("n_duplicates"), spelled("missing"), spelled("duplicates"), "label", F.col("min").alias("lo"), F.col("max").alias("hi"))


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Ch. ' || p_size || ' ' || p_name || '.pdf' WHEN 1 THEN p_name || ' ' || p_size || '.pdf' WHEN 2 THEN p_name || '.pdf' ELSE 'Vol #' || p_size || '.pdf' END AS name, p_size, p_name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE p_size END AS num, CASE p_partkey % 4 WHEN 0 THEN 'Chapter' WHEN 3 THEN 'Volume' END AS label,
  CASE p_partkey % 4 WHEN 0 THEN 'Chapter ' || p_size WHEN 1 THEN p_name || ' ' || p_size WHEN 2 THEN p_name ELSE 'Volume ' || p_size END AS title FROM p""")
def q_extract_number(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    name = F.when(k == 0, F.concat(F.lit("Ch. "), size, F.lit(" "), F.col("p_name"), F.lit(".pdf"))).when(k == 1, F.concat(F.col("p_name"), F.lit(" "), size, F.lit(".pdf"))).when(k == 2, F.concat(F.col("p_name"), F.lit(".pdf"))).otherwise(F.concat(F.lit("Vol #"), size, F.lit(".pdf")))
    found = sequence.extract_number(name)
    return p.select("p_partkey", found["num"].alias("num"), found["label"].alias("label"), sequence.chapter_title(name).alias("title"))


@query("""
WITH n AS (SELECT DISTINCT l_orderkey AS g, CAST(l_linenumber + (l_partkey % 3) AS INT) AS num FROM lineitem),
r AS (SELECT g, num, num - row_number() OVER (PARTITION BY g ORDER BY num) AS k FROM n),
i AS (SELECT g, min(num) AS a, max(num) AS b FROM r GROUP BY g, k)
SELECT g AS orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) AS ranges FROM i GROUP BY g""")
def q_number_ranges(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int").alias("num")).distinct()
    return islands.number_ranges(n, ["orderkey"], "num")


@query("SELECT l_orderkey, l_linenumber, l_linenumber * 1e6 + l_partkey AS key FROM lineitem")
def q_title_key(spark, sf_dir):
    t = F.format_string("Vol. %d Ch %d", "l_linenumber", "l_partkey")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sequence.title_key(t).alias("key"))


@query("""
WITH p AS (SELECT p_partkey, p_name || ' ' || (p_partkey % 1000) AS name, p_name, p_partkey % 1000 AS n FROM part)
SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY n, p_partkey) AS pos FROM p""")
def q_natural_order(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 1000).cast("string")))
    w = Window.partitionBy("p_name").orderBy(text.natural_key(F.col("name")), "p_partkey")
    return p.select("p_partkey", F.row_number().over(w).alias("pos"))


# Order


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events),
k AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e WHERE v IS NOT NULL),
s AS (SELECT user_id, count(*) FILTER (v > p) AS up, count(*) FILTER (v < p) AS down FROM k GROUP BY 1)
SELECT user_id, up, down, coalesce(CASE WHEN up + down < 2 THEN NULL WHEN down > 2 * up THEN true WHEN up > 2 * down THEN false END, false) AS newest_first FROM s""")
def q_order_vote(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    votes = ordering.step_votes(e, "user_id", "event_id", "v")
    return votes.withColumn("newest_first", F.coalesce(ordering.vote(F.col("up"), F.col("down")), F.lit(False)))


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events),
h AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS pid FROM e)
SELECT h.user_id, h.event_id, row_number() OVER (PARTITION BY h.user_id ORDER BY h.pid IS NOT NULL, p.value, h.pid, h.event_id) - 1 AS pos FROM h LEFT JOIN events p ON p.event_id = h.pid""")
def q_neighbour_sort(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return ordering.keep_neighbours(e, "user_id", "event_id", "v").select("user_id", "event_id", F.col("pos").cast("long").alias("pos"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN n >= 2 THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, position DESC) ELSE 1 END - 1 AS pos FROM o""")
def q_oldest_first(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("date"), F.row_number().over(w).alias("position"), F.lit(None).cast("double").alias("number"), F.lit("newest-first").alias("order"))
    return ordering.oldest_first(o, "o_custkey").select("o_custkey", "o_orderkey", F.col("pos").cast("long").alias("pos"))


# Retention and look-ups


@query("""
WITH o AS (SELECT *, row_number() OVER w AS ord, count(*) OVER (PARTITION BY o_custkey) AS n, sum(b) OVER (PARTITION BY o_custkey) AS total, coalesce(sum(b) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM (SELECT o_custkey, o_orderkey, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, o_orderkey, ord FROM o WHERE (n - (ord - 1) > 8 OR total - gone > 1000000) AND ord <= n - 2""")
def q_prune(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return retention.prune_victims(o, ["o_custkey"], "o_orderdate", "o_orderkey", F.floor("o_totalprice"), count_cap=8, budget=1_000_000, keep_at_least=2).select("o_custkey", "o_orderkey", "ord")


@query("""
WITH d AS (SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id FROM d WHERE before < 20000""")
def q_free_space(spark, sf_dir):
    return retention.free_space(read(spark, sf_dir, "documents"), ["source"], "doc_id", "doc_id", F.col("n_chars"), 20000).select("source", "doc_id")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def q_dedupe_first(spark, sf_dir):
    return joins.first_of_each(read(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey")
def q_left_lookup(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.lookup(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END AS p_name FROM part")
def q_rename(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    new = p.where("p_partkey % 5 = 0 or p_partkey % 5 = 1").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(" ").alias("p_name"))
    return joins.rename(p.select("p_partkey", "p_name"), new, "p_partkey", "p_name")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q_semi(spark, sf_dir):
    chosen = read(spark, sf_dir, "labels").where("toxic = 1")
    return joins.selected_or_all(read(spark, sf_dir, "documents").select("doc_id", "lang"), chosen, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_anti(spark, sf_dir):
    return joins.without(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 3""")
def q_ring_buffer(spark, sf_dir):
    return joins.last_n(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "rank")


@query("""
WITH f AS (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type, ',' ORDER BY last DESC) AS recent FROM f GROUP BY user_id""")
def q_mru(spark, sf_dir):
    """The names used by each user, most recent first: a fold over the ordered uses."""
    uses = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    step = lambda names, used: (made := [used, *(n for n in names if n != used)][:12], (",".join(made),))
    held = ordered_fold(uses, ["user_id"], ["event_id"], ["event_type"], list, step, "recent string")
    return held.groupBy("user_id").agg(F.max_by("recent", "event_id").alias("recent"))


# Rules and colours


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS r FROM lineitem),
u AS (SELECT *, least(1.0, greatest(0.0, r)) AS t FROM t),
c AS (SELECT l_orderkey, l_linenumber, t, CASE WHEN t < 0.5 THEN 209 + (194 - 209) * t * 2 ELSE 194 + (31 - 194) * (t - 0.5) * 2 END AS a,
  CASE WHEN t < 0.5 THEN 31 + (162 - 31) * t * 2 ELSE 162 + (158 - 162) * (t - 0.5) * 2 END AS b, CASE WHEN t < 0.5 THEN 31 + (0 - 31) * t * 2 ELSE 0 + (61 - 0) * (t - 0.5) * 2 END AS c FROM u)
SELECT l_orderkey, l_linenumber, 'rgb(' || floor(a + 0.5)::INT || ',' || floor(b + 0.5)::INT || ',' || floor(c + 0.5)::INT || ')' AS color FROM c""")
def q_percent_ramp(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.percent_color(F.col("l_discount") * 10, rules.Rules()).alias("color"))


@query("""
WITH p AS (SELECT p_partkey, (p_partkey * 7919) % 256 AS r, (p_partkey * 104729) % 256 AS g, (p_partkey * 1299709) % 256 AS b FROM part),
l AS (SELECT *, (299 * r + 587 * g + 114 * b) / 1000.0 / 255 AS grey,
  0.2126 * (CASE WHEN r / 255.0 <= 0.03928 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END) + 0.7152 * (CASE WHEN g / 255.0 <= 0.03928 THEN g / 255.0 / 12.92 ELSE pow((g / 255.0 + 0.055) / 1.055, 2.4) END) + 0.0722 * (CASE WHEN b / 255.0 <= 0.03928 THEN b / 255.0 / 12.92 ELSE pow((b / 255.0 + 0.055) / 1.055, 2.4) END) AS y FROM p)
SELECT p_partkey, round(1.05 / (y + 0.05), 6) AS on_white, round((y + 0.05) / 0.05, 6) AS on_black, round(grey, 6) AS grey,
  CASE WHEN 1.05 / (y + 0.05) < 2.5 THEN 'light' WHEN (y + 0.05) / 0.05 < 2.5 THEN 'dark' END AS fails FROM l""")
def q_contrast(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    c = F.format_string("#%02X%02x%02x", (F.col("p_partkey") * 7919) % 256, (F.col("p_partkey") * 104729) % 256, (F.col("p_partkey") * 1299709) % 256)
    seen = rules.check_color(c)
    return p.select("p_partkey", F.round(seen["on_white"], 6).alias("on_white"), F.round(seen["on_black"], 6).alias("on_black"), F.round(rules.perceived(c), 6).alias("grey"), seen["fails"].alias("fails"))


@query("""
SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'small' THEN 'rarity-low' WHEN 'red' THEN 'rarity-high' END AS class FROM part WHERE split_part(p_name, ' ', 1) IN ('small', 'red')""")
def q_rule_tags(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a ["), F.initcap(F.split("p_name", " ")[0]), F.lit("] thing [Nothing]")).alias("t"))
    words = spark.createDataFrame([("small", 0, "rarity-none"), ("Small", 1, "rarity-low"), ("red", 2, "rarity-high")], "word string, ord int, class string")
    return rules.tag_matches(p, words, "p_partkey", "t").select("p_partkey", "class")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS INT) AS a, CAST(round(l_tax * 100) AS INT) AS b FROM lineitem),
r AS (SELECT *, CASE WHEN b > 0 THEN least(1.0, a / b) ELSE a / 100 END AS t FROM l),
c AS (SELECT *, CASE WHEN t < 0.5 THEN 209 + (194 - 209) * t * 2 ELSE 194 + (31 - 194) * (t - 0.5) * 2 END AS x,
  CASE WHEN t < 0.5 THEN 31 + (162 - 31) * t * 2 ELSE 162 + (158 - 162) * (t - 0.5) * 2 END AS y, CASE WHEN t < 0.5 THEN 31 + (0 - 31) * t * 2 ELSE 0 + (61 - 0) * (t - 0.5) * 2 END AS z FROM r)
SELECT l_orderkey, l_linenumber, 'Power: <span class="pct" style="font-weight:700;color:rgb(' || floor(x + 0.5)::INT || ',' || floor(y + 0.5)::INT || ',' || floor(z + 0.5)::INT || ')">' || a || '%</span> of <span class="pct" style="font-weight:700;color:'
  || CASE WHEN b > 0 THEN 'rgb(31,158,61)' ELSE 'rgb(209,31,31)' END || '">' || b || '%</span>' AS html FROM c""")
def q_percent_pairs(spark, sf_dir):
    a, b = (F.round(F.col(c) * 100).cast("int").cast("string") for c in ("l_discount", "l_tax"))
    t = F.concat(F.lit("Power: "), a, F.lit("% of "), b, F.lit("%"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.style_stat(t, rules.Rules()).alias("html"))


@query("""
SELECT p_partkey, 'Name: ' || split_part(p_name, ' ', 1) || '|Build Quality: [Rank: ' || p_size || ']|Est. Value: ' || p_size AS fields FROM part""")
def q_labeled_fields(spark, sf_dir):
    t = F.concat(F.lit("Name: "), F.split("p_name", " ")[0], F.lit(" Build Quality: [Rank: "), F.col("p_size"), F.lit("] Est. Value: "), F.col("p_size"))
    p = read(spark, sf_dir, "part").select("p_partkey", t.alias("text"))
    return sheets.with_fields(p).select("p_partkey", F.array_join("fields", "|").alias("fields"))


@query("""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS b FROM conversations),
h AS (SELECT *, regexp_matches(t, '\\[[0-9]|%|\\]') AS hint FROM l),
g AS (SELECT *, b - row_number() OVER (PARTITION BY conv_id, turn ORDER BY b) AS k FROM h WHERE hint),
r AS (SELECT conv_id, turn, min(b) AS first, count(*) AS size FROM g GROUP BY conv_id, turn, k),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, turn, first) = 1),
n AS (SELECT conv_id, turn, count(*) AS n FROM l GROUP BY 1, 2),
longest AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, turn) = 1),
w AS (SELECT n.conv_id, n.turn, n.n, size, first, CASE WHEN size IS NOT NULL THEN least(n.n, greatest(10, size)) END AS target
  FROM longest l LEFT JOIN best USING (conv_id) JOIN n ON n.conv_id = l.conv_id AND n.turn = coalesce(best.turn, l.turn)),
e AS (SELECT *, CASE WHEN target IS NOT NULL THEN least(n, greatest(first - (target - size) // 2, 0) + target) ELSE least(n, 15) END AS stop FROM w)
, f AS (SELECT *, coalesce(greatest(0, stop - target), 0) AS start FROM e)
SELECT f.conv_id, f.turn, count(*) AS shown, min(b)::INT AS first_block, md5(string_agg(t, chr(10) ORDER BY b)) AS h FROM f JOIN l ON l.conv_id = f.conv_id AND l.turn = f.turn AND b >= start AND b < stop GROUP BY 1, 2""")
def q_sample_blocks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chapter_no"), F.posexplode(F.split("text", "\n", -1)).alias("block_no", "text"), F.lit("p").alias("type"))
    return sheets.sample_blocks(c).groupBy(F.col("book_id").alias("conv_id"), F.col("chapter_no").alias("turn")).agg(F.count("*").alias("shown"), F.min("block_no").alias("first_block"), F.md5(islands.joined_text(F.col("text"), F.col("block_no"), "\n")).alias("h"))


@query("""
WITH p AS (SELECT p_brand, p_partkey, (p_partkey * 7919) % 256 AS r, (p_partkey * 104729) % 256 AS g, (p_partkey * 1299709) % 256 AS b FROM part),
y AS (SELECT p_brand, p_partkey, (0.299 * r + 0.587 * g + 0.114 * b) / 255 AS y FROM p),
d AS (SELECT p_brand, lag(p_partkey) OVER w AS a, p_partkey AS b, abs(lag(y) OVER w - y) AS delta FROM y WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
SELECT p_brand, a, b, round(delta, 6) AS delta FROM d WHERE delta < 0.1""")
def q_grey_clashes(spark, sf_dir):
    c = F.format_string("#%02x%02x%02x", (F.col("p_partkey") * 7919) % 256, (F.col("p_partkey") * 104729) % 256, (F.col("p_partkey") * 1299709) % 256)
    tiers = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_partkey").alias("label"), c.alias("color"))
    return palette.grey_clashes(tiers, "p_brand", "p_partkey").select("p_brand", "a", "b", F.round("delta", 6).alias("delta"))


@query("""
WITH c AS (SELECT p_partkey, ((p_partkey * 7919) % 256) AS r, ((p_partkey * 104729) % 256) AS g, ((p_partkey * 1299709) % 256) AS b FROM part),
d AS (SELECT DISTINCT r, g, b, r / 255.0 AS x, g / 255.0 AS y, b / 255.0 AS z FROM c),
m AS (SELECT *, greatest(x, y, z) AS hi, least(x, y, z) AS lo FROM d),
l AS (SELECT *, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 <= 0.5 THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2 - hi - lo) END AS s,
  CASE WHEN hi = lo THEN 0 WHEN x = hi THEN (y - z) / (hi - lo) WHEN y = hi THEN 2 + (z - x) / (hi - lo) ELSE 4 + (x - y) / (hi - lo) END / 6 AS h FROM m),
t AS (SELECT *, step, side, l + side * step / 100.0 AS tried FROM l, (SELECT unnest(range(0, 101)) AS step) a, (SELECT unnest([-1, 1]) AS side) b WHERE step > 0 OR side = 1),
q AS (SELECT *, CASE WHEN tried <= 0.5 THEN tried * (1 + s) ELSE tried + s - tried * s END AS q2 FROM t WHERE tried BETWEEN 0 AND 1),
k AS (SELECT r, g, b, step, side, i, 2 * tried - q2 AS q1, q2, h + (1 - i) / 3.0 - floor(h + (1 - i) / 3.0) AS u FROM q, (SELECT unnest([0, 1, 2]) AS i) w),
v AS (SELECT r, g, b, step, side, i, CASE WHEN step = 0 THEN [r, g, b][i + 1] ELSE least(255, greatest(0, floor((CASE WHEN u < 1 / 6.0 THEN q1 + (q2 - q1) * u * 6 WHEN u < 0.5 THEN q2 WHEN u < 2 / 3.0 THEN q1 + (q2 - q1) * (2 / 3.0 - u) * 6 ELSE q1 END) * 255 + 0.5))) END::INT AS n FROM k),
y AS (SELECT r, g, b, step, side, '#' || string_agg(lower(lpad(printf('%X', n), 2, '0')), '' ORDER BY i) AS color,
  sum([0.2126, 0.7152, 0.0722][i + 1] * CASE WHEN n / 255.0 <= 0.03928 THEN n / 255.0 / 12.92 ELSE pow((n / 255.0 + 0.055) / 1.055, 2.4) END) AS lum FROM v GROUP BY r, g, b, step, side),
f AS (SELECT r, g, b, arg_min(color, step * 10 + side) AS fixed FROM y WHERE 1.05 / (lum + 0.05) >= 2.5 AND (lum + 0.05) / 0.05 >= 2.5 GROUP BY r, g, b)
SELECT p_partkey, lower(printf('#%02x%02x%02x', c.r, c.g, c.b)) AS color, coalesce(fixed, '#808080') AS fixed FROM c LEFT JOIN f ON f.r = c.r AND f.g = c.g AND f.b = c.b""")
def q_fix_colors(spark, sf_dir):
    c = F.format_string("#%02x%02x%02x", (F.col("p_partkey") * 7919) % 256, (F.col("p_partkey") * 104729) % 256, (F.col("p_partkey") * 1299709) % 256)
    return palette.fix_colors(read(spark, sf_dir, "part").select("p_partkey", c.alias("color")), "color")


@query()
def q_render(spark, sf_dir):
    """Documents' lines as blocks, some of them bullets or fields, rendered as chapters."""
    lines = doc_lines(spark, sf_dir)
    kind = F.when(F.col("line_no") % 5 == 4, "li").otherwise("p")
    body = F.when(F.col("line_no") % 7 == 3, F.concat(F.lit("Power: 3 of 4 Range: [A][B] Hit: 20% of 40% "), F.col("text"))).otherwise(F.col("text"))
    blocks = lines.select("doc_id", F.col("line_no").alias("block_no"), kind.alias("type"), body.alias("text"), F.lit(None).cast("array<struct<text:string,marks:array<string>,br:boolean>>").alias("runs"), F.lit(None).cast("string").alias("align"), F.lit(None).cast("string").alias("role"))
    return sheets.render(blocks, rules.Rules())


@query("""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^a-z]+', ' ', 'g'), ' ') AS t FROM documents),
b AS (SELECT doc_id, k, t, k % 5 = 4 AS li, k % 7 = 3 AS f, CASE WHEN k % 13 = 12 THEN 'hr' WHEN k % 11 = 6 THEN 'quote' WHEN k % 5 = 4 OR k % 7 = 3 THEN 'stat' ELSE 'prose' END AS kind FROM l WHERE t <> ''),
s AS (SELECT *, 'Hit: <span class="pct" style="font-weight:700;color:rgb(194,162,0)">20%</span> of <span class="pct" style="font-weight:700;color:rgb(31,158,61)">40%</span> ' || t AS hit FROM b),
r AS (SELECT *, CASE WHEN kind IN ('stat', 'quote') AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS sr, CASE WHEN li AND lag(li) OVER w AND kind = 'stat' AND lag(kind) OVER w = 'stat' THEN 0 ELSE 1 END AS st FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
r2 AS (SELECT *, sum(sr) OVER (PARTITION BY doc_id ORDER BY k) AS run, sum(st) OVER (PARTITION BY doc_id ORDER BY k) AS sub FROM r),
i AS (SELECT doc_id, run, sub, min(k) AS k, any_value(kind) AS kind, bool_and(li) AS li, count(*) AS n, bool_or(f) AS strong,
  string_agg(CASE WHEN li THEN '<li>' || CASE WHEN f THEN 'Power: 3 of 4 Range: [A][B] ' || hit ELSE t END || '</li>' ELSE '<div class="stat-line">Power: 3 of 4</div><div class="stat-line">Range: [A][B]</div><div class="stat-line">' || hit || '</div>' END, '' ORDER BY k) AS sheet,
  string_agg('<p>' || CASE WHEN f THEN 'Power: 3 of 4 Range: [A][B] ' || hit ELSE t END || '</p>', '' ORDER BY k) AS flow FROM r2 GROUP BY 1, 2, 3),
h AS (SELECT doc_id, run, min(k) AS k, any_value(kind) AS kind, sum(n) AS n, bool_or(strong) AS strong, string_agg(CASE WHEN kind = 'stat' AND li THEN '<ul class="stat-block">' || sheet || '</ul>' WHEN kind = 'stat' THEN sheet ELSE flow END, '' ORDER BY k) AS body FROM i GROUP BY 1, 2)
SELECT doc_id, string_agg(CASE kind WHEN 'hr' THEN '<hr class="scene-break" />' WHEN 'quote' THEN '<blockquote>' || body || '</blockquote>' WHEN 'prose' THEN body ELSE CASE WHEN n >= 2 OR strong THEN '<div class="stat-sheet">' || body || '</div>' ELSE body END END, chr(10) ORDER BY k) AS html FROM h GROUP BY 1""")
def q_render_sheets(spark, sf_dir):
    """Documents' lines, in letters, as prose, bullets, fields with a pair of percentages, quotations and scene breaks: whole
    chapters in HTML."""
    k, plain = F.col("line_no"), F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    lines = doc_lines(spark, sf_dir).withColumn("t", plain).where("t <> ''")
    kind = F.when(k % 13 == 12, "hr").when(k % 5 == 4, "li").otherwise("p")
    body = F.when(k % 7 == 3, F.concat(F.lit("Power: 3 of 4 Range: [A][B] Hit: 20% of 40% "), F.col("t"))).otherwise(F.col("t"))
    role = F.when((k % 11 == 6) & (k % 13 != 12), "blockquote")
    blocks = lines.select("doc_id", k.alias("block_no"), kind.alias("type"), body.alias("text"), F.lit(None).cast("array<struct<text:string,marks:array<string>,br:boolean>>").alias("runs"), F.lit(None).cast("string").alias("align"), role.alias("role"))
    return sheets.render(blocks, rules.Rules())


# Markup and feeds


@query("""
SELECT page_id, 'i' || page_id || ',j' AS ids FROM (SELECT page_id FROM pages)""")
def q_collection(spark, sf_dir):
    own = F.concat(F.lit("i"), F.col("page_id").cast("string"))
    post = lambda i: F.struct(i.alias("id"), F.lit("post").alias("type"))
    body = F.to_json(F.struct(F.array(post(own), post(F.lit("j")), post(own)).alias("included")))
    found = feeds.collection(body)
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(found, lambda p: p["id"]), ",").alias("ids"))


@query("""
SELECT p_partkey, '<metadata>' || chr(9) || chr(9) || '<meta name="calibre:series" content="' || p_brand || '" />' || chr(10) || chr(9) || chr(9) || '<meta name="calibre:series_index" content="' || p_size || '" />' || chr(10) || chr(9) || chr(9)
  || '<meta property="belongs-to-collection" id="series">' || p_brand || '</meta>' || chr(10) || chr(9) || chr(9) || '<meta refines="#series" property="collection-type">series</meta>' || chr(10) || chr(9) || chr(9) || '<meta refines="#series" property="group-position">' || p_size || '</meta>'
  || chr(10) || chr(9) || '</metadata>' AS opf FROM part""")
def q_series_metadata(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", packages.with_series(F.lit("<metadata></metadata>"), F.col("p_brand"), F.col("p_size").cast("double")).alias("opf"))


@query("""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, len(list_distinct(l))::INT AS links, l[1] AS first_link FROM p""")
def q_links(spark, sf_dir):
    found = markup.links(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.size(found).alias("links"), F.get(found, F.lit(0)).alias("first_link"))


@query("""
WITH q AS (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:[ \\t\\r\\n][^>]*)?>(.*?)</p>', 1) AS ts FROM pages),
p AS (SELECT page_id, i, ts[i] AS t FROM (SELECT page_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM q)),
d AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\\s\\x0B]+', ' ', 'g')) AS t FROM p)
SELECT page_id, count(*) AS paragraphs, sum(length(t))::BIGINT AS chars, md5(string_agg(t, chr(10) ORDER BY i)) AS h FROM d WHERE t <> '' GROUP BY page_id""")
def q_html_text(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", markup.paragraphs(F.col("html")).alias("t")).where(F.size("t") > 0)
    return p.select("page_id", F.size("t").cast("long").alias("paragraphs"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), F.md5(F.array_join("t", "\n")).alias("h"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS nav, regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS ad, string_split(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>') AS parts, regexp_extract(html, '<footer>([^<]*)</footer>', 1) AS foot FROM pages),
b AS (
  SELECT page_id, i AS o, 'li' AS type, nav[i] AS raw, NULL AS role, NULL AS part FROM (SELECT page_id, nav, unnest(range(1, len(nav) + 1)) AS i FROM p)
  UNION ALL SELECT page_id, 1000, 'p', ad, NULL, NULL FROM p
  UNION ALL SELECT page_id, 1000 + i, 'p', parts[i], CASE WHEN i = 1 THEN 'h1' END, i FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)
  UNION ALL SELECT page_id, 1000000, 'p', foot, NULL, NULL FROM p),
m AS (SELECT *, max(CASE WHEN raw LIKE '%<b>%' THEN part END) OVER w AS opened, max(CASE WHEN raw LIKE '%</%' THEN part END) OVER (PARTITION BY page_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM b WINDOW w AS (PARTITION BY page_id ORDER BY part)),
t AS (SELECT page_id, o, type, role, part IS NOT NULL AND opened > coalesce(closed, 0) AS bold, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM m)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY o) - 1)::INT AS block_no, type, text, role, NULL AS align, CASE WHEN bold THEN '<strong>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</strong>' ELSE '' END AS rich FROM t WHERE text <> ''""")
def q_html_blocks(spark, sf_dir):
    """Whole pages as blocks: lists, headings, paragraphs that are or aren't closed, and marks that go on over their borders."""
    blocks = markup.with_blocks(read(spark, sf_dir, "pages").select("page_id", "html"), "html", markup.html_to_blocks)
    return blocks.select("page_id", F.posexplode("blocks").alias("block_no", "b")).select("page_id", "block_no", "b.type", "b.text", "b.role", "b.align", markup.render_runs(F.coalesce("b.runs", F.array().cast(markup.BLOCK.split("runs:")[1].split(",align")[0]))).alias("rich"))


@query("""
SELECT event_id // 10 AS run_id, event_id, 'p' || (event_id % 7) AS id FROM events WHERE event_id % 10 < 9 QUALIFY row_number() OVER (PARTITION BY event_id // 10, event_id % 7 ORDER BY event_id) = 1""")
def q_feed_crawl(spark, sf_dir):
    """Ten events make a run, three a page; ids repeat after seven. The last event stands for a page that isn't JSON."""
    e = read(spark, sf_dir, "events").withColumn("run_id", F.expr("event_id div 10")).withColumn("k", F.col("event_id") % 10)
    post = F.struct(F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("id"), F.lit("post").alias("type"), F.struct(F.col("event_id").cast("string").alias("title")).alias("attributes"))
    good = e.where("k < 9").groupBy("run_id", F.expr("cast(k div 3 as int)").alias("page")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", post.alias("p")))), lambda x: x["p"]).alias("data"))).alias("body"))
    bad = e.where("k = 9").select("run_id", F.lit(3).alias("page"), F.lit("<html>").alias("body"))
    pages = good.unionByName(bad)
    return feeds.crawl(feeds.parse_pages(pages), pages).select("run_id", F.col("title").cast("long").alias("event_id"), "id")


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def q_json_fields(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "struct<k:long>")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


# Policy


_STREAKS = """
WITH e AS (SELECT user_id, event_id, event_type = 'error' AS f, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS streak FROM e),
r AS (SELECT user_id, streak::BIGINT AS streak, count(*) AS length, min(event_id) AS first, max(event_id) AS last FROM s WHERE f GROUP BY 1, 2)
"""


def _streaks(spark, sf_dir):
    return policy.failure_streaks(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error")


@query(_STREAKS + "SELECT * FROM r")
def q_streaks(spark, sf_dir):
    return _streaks(spark, sf_dir)


@query(_STREAKS + "SELECT user_id, streak, least(length // 3, 3)::INT AS pauses, CASE least(length // 3, 3) WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 90 ELSE 210 END AS seconds, length // 3 > 3 AS halted FROM r")
def q_pauses(spark, sf_dir):
    return policy.pauses(_streaks(spark, sf_dir), ["user_id"])


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f(user_id, k, streak, lim) AS (
  SELECT user_id, 0, 0, 3 FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT e.user_id, e.k, CASE WHEN ok AND streak < 19 THEN streak + 1 ELSE 0 END, CASE WHEN NOT ok THEN 1 WHEN streak >= 19 THEN least(3, lim + 1) ELSE lim END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, arg_max(lim, k)::INT AS "limit" FROM f GROUP BY 1""")
def q_adaptive_pool(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    return policy.pool_sizes(e, ["user_id"], ["event_id"], "ok").groupBy("user_id").agg(F.max_by("limit", "event_id").alias("limit"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS st FROM events),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def q_debounce(spark, sf_dir):
    return streaming.quiet_periods(read(spark, sf_dir, "events"), "6 hours")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id")
def q_stream_breaker(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _folder(spark, sf_dir, "events") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    out = streaming.breaker(e.select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed")))
    return streaming.once(out, spark, "update").groupBy("user_id").agg(F.max("failures").alias("failures"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type <> 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS j FROM e WHERE failed)
SELECT u.user_id, (SELECT count(*) FROM e WHERE e.user_id = u.user_id AND failed) AS failures, floor(epoch((SELECT min(ts) FROM r WHERE r.user_id = u.user_id AND j = 12)))::BIGINT AS halted FROM (SELECT DISTINCT user_id FROM events) u""")
def q_stream_halts(spark, sf_dir):
    """All but errors as failures: when a user's run is halted, at the twelfth failure in a row."""
    schema = read(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _folder(spark, sf_dir, "events") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    out = streaming.breaker(e.select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("failed")))
    return streaming.once(out, spark, "update").groupBy("user_id").agg(F.max("failures").alias("failures"), F.unix_seconds(F.min("halted_at")).alias("halted"))


def _folder(spark: SparkSession, sf_dir: str, name: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("""
WITH c AS (SELECT conv_id AS book_id, turn, role || ' ' || turn || ' &' AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
b AS (SELECT book_id, count(*) AS pages, string_agg('page-' || n || '.xhtml=' || replace(title, '&', '&amp;'), '|' ORDER BY n) AS toc, string_agg('OEBPS/page-' || n || '.xhtml', ',' ORDER BY n) AS files FROM c GROUP BY 1)
SELECT book_id, 'mimetype,META-INF/container.xml,OEBPS/content.opf,OEBPS/toc.ncx,OEBPS/nav.xhtml,OEBPS/style.css,OEBPS/table-of-contents.xhtml,' || CASE WHEN book_id % 2 = 0 THEN 'OEBPS/cover-image.png,OEBPS/front-cover.xhtml,' ELSE '' END
  || files || CASE WHEN book_id % 3 = 0 THEN ',OEBPS/notes.xhtml' ELSE '' END AS files, toc || CASE WHEN book_id % 3 = 0 THEN '|notes.xhtml=Notes' ELSE '' END AS toc, pages + 1 + CASE WHEN book_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN book_id % 3 = 0 THEN 1 ELSE 0 END AS spine FROM b""")
def q_packages(spark, sf_dir):
    """A book of each conversation, each second with a cover, each third with notes: packages made and opened again; their
    entries in order, what their navigation maps list, and how long their spines are."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("int").alias("ord"), F.concat("role", F.lit(" "), F.col("turn").cast("string"), F.lit(" &")).alias("title"), F.concat(F.lit("<p>"), text.escape_xml(F.col("text")), F.lit("</p>")).alias("body"))
    about = c.select("book_id").distinct().select("book_id", F.lit("T & U").alias("title"), F.lit("A").alias("author"), F.when(F.col("book_id") % 3 == 0, "n").alias("notes"), F.when(F.col("book_id") % 2 == 0, F.lit(b"\x89PNG")).alias("cover"))
    made = packages.zip_books(packages.entries(c, about, ".x{}"))

    def opened(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            zips = [zipfile.ZipFile(io.BytesIO(x)) for x in b["package"]]
            opf = [z.read("OEBPS/content.opf").decode() for z in zips]
            yield pd.DataFrame({"book_id": b["book_id"], "files": [",".join(z.namelist()) for z in zips], "ncx": [z.read("OEBPS/toc.ncx").decode() for z in zips], "spine": [x.count("<itemref ") for x in opf]})

    read_back = made.mapInPandas(opened, "book_id long, files string, ncx string, spine long")
    toc = F.array_join(F.transform(packages.nav_entries(F.col("ncx")), lambda e: F.concat(e["src"], F.lit("="), e["title"])), "|")
    return read_back.select("book_id", "files", toc.alias("toc"), "spine")


_SEGMENTS = """
WITH s AS (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents),
l0 AS (SELECT source, doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS line_no, len(ls) AS n FROM s),
e AS (SELECT *, line_no < 2 OR line_no >= n - 2 AS edge, lower(trim(regexp_replace(regexp_replace(t, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))) AS key FROM l0),
q AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY 1),
h AS (SELECT source, key, count(DISTINCT doc_id) AS pages FROM e WHERE edge AND key <> '' GROUP BY 1, 2),
r AS (SELECT source, key FROM h JOIN q USING (source) WHERE pages >= 3 AND pages > 0.1 * n_pages),
l AS (SELECT e.* FROM e LEFT JOIN r ON r.source = e.source AND r.key = e.key WHERE NOT (edge AND (r.key IS NOT NULL OR regexp_full_match(t, '\\s*[0-9]+\\s*')))),
"""


@query(_SEGMENTS + """
p AS (SELECT *, line_no % 5 = 4 AS bullet, lag(t) OVER w AS pt, lag(line_no % 5 = 4) OVER w AS pb FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
f AS (SELECT *, CASE WHEN pt IS NULL OR bullet OR length(pt) % 3 = 0 OR (pb AND NOT regexp_matches(t, '^[a-z]')) THEN 1 ELSE 0 END AS st FROM p),
i AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM f),
b AS (SELECT doc_id, block, count(*) AS n_lines, max(n) AS n, CASE WHEN bool_or(bullet) THEN regexp_replace(string_agg(t, ' ' ORDER BY line_no), '^\\s+|\\s+$', '', 'g') ELSE string_agg(t, ' ' ORDER BY line_no) END AS t FROM i GROUP BY 1, 2)
SELECT doc_id, count(*) AS blocks, sum(n_lines)::BIGINT AS n_lines, (max(n) - sum(n_lines))::BIGINT AS stripped, md5(string_agg(t, chr(10) ORDER BY block)) AS h FROM b GROUP BY doc_id""")
def q_segmentation(spark, sf_dir):
    """Documents to lines; what stands at the edges of more than a tenth of a source's documents, and page numbers there,
    are taken off by an anti-join; blocks are assembled from the rest."""
    lines = doc_lines(spark, sf_dir).select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_no"), "line_no", "text")
    pages = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("book_id")).agg(F.count("*").alias("n_pages"))
    kept = layout.strip_running_heads(lines, pages, share=0.1).withColumnRenamed("page_no", "doc_id")
    blocks = layout.assemble_blocks(_geometry(kept))
    found = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum("n_lines").alias("n_lines"), F.md5(islands.joined_text(F.col("text"), F.col("block_no"), "\n")).alias("h"))
    whole = read(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n", -1)).alias("_n"))
    return found.join(whole, "doc_id").select("doc_id", "blocks", "n_lines", (F.col("_n") - F.col("n_lines")).alias("stripped"), "h")


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_segmentation(spark, sf_dir)


from folio.plans import function_queries, library_queries, source_queries  # noqa: E402, F401  register their queries too
