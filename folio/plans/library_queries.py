"""Queries of files, queues, the library, crawls and policies over the test tables, and SQL that says the same independently."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import islands, library, palette, policy, queue
from folio.plans.registry import query, read
from folio.runtime import spread
from folio.sources import feeds, files, packages

# Files


def _files(spark, sf_dir):
    """Documents as files: each seventh can't be read, each eleventh has no text, each thirteenth has two pages of it."""
    d = read(spark, sf_dir, "documents").withColumn("b", F.col("text").cast("binary"))
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(b"\x00"), "b")).when(F.col("doc_id") % 11 == 0, F.lit(b" \x0c\n")).when(F.col("doc_id") % 13 == 0, F.concat("b", F.lit(b"\x0c"), "b")).otherwise(F.col("b"))
    return d.select(F.col("doc_id").cast("int").alias("position"), F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), content.alias("content"))


_FILES = """
WITH d AS (SELECT doc_id, doc_id % 7 = 0 AS bad, doc_id % 11 = 0 AS blank, CASE WHEN doc_id % 11 = 0 THEN 2 WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS pages,
  len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\s\\x1c-\\x1f\\x85\\xa0]'))) AS n FROM documents),
f AS (SELECT doc_id, bad, pages, CASE WHEN blank THEN 0 ELSE n * pages END AS fragments FROM d)
"""


@query(_FILES + "SELECT doc_id AS position, 'file ' || doc_id AS title, pages, fragments, fragments = 0 AS empty FROM f WHERE NOT bad")
def q_file_scan(spark, sf_dir):
    return files.chapters(files.readable(files.parse_files(_files(spark, sf_dir))))


@query(_FILES + "SELECT doc_id AS position, 'file ' || doc_id || '.txt' AS name, 'not a text file' AS error FROM f WHERE bad")
def q_file_failures(spark, sf_dir):
    return files.failures(files.parse_files(_files(spark, sf_dir)))


@query(_FILES + "SELECT count(*) AS files, count(*) FILTER (bad) AS failures, sum(pages) FILTER (NOT bad)::BIGINT AS pages, count(*) FILTER (NOT bad AND fragments = 0) AS empty FROM f")
def q_file_counters(spark, sf_dir):
    return files.counters(files.parse_files(_files(spark, sf_dir)))


@query(_FILES + """
, p AS (SELECT doc_id, unnest(range(1, pages + 1)) AS page_no FROM f WHERE NOT bad)
SELECT doc_id AS position, page_no::INT AS page_no, row_number() OVER (ORDER BY doc_id, page_no) AS page FROM p""")
def q_joined_pages(spark, sf_dir):
    return files.joined_pages(files.parse_files(_files(spark, sf_dir)))


@query(_FILES + "SELECT doc_id AS position, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id ELSE 'file ' || doc_id END AS title FROM f WHERE NOT bad")
def q_zip_titles(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("doc_id % 2 = 0 or doc_id % 3 = 0")
    titles = d.select(F.col("doc_id").cast("int").alias("position"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Title "), F.col("doc_id").cast("string"), F.lit("\t"))).otherwise(" ").alias("title"))
    return files.chapters(files.parse_files(_files(spark, sf_dir)), titles).select("position", "title")


@query("SELECT user_id, event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS running FROM events")
def q_running_sum(spark, sf_dir):
    return islands.running_sum(read(spark, sf_dir, "events").select("user_id", "event_id"), "event_id", ["user_id"], "event_id", 16)


# Queue


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT *, n >= 3 AS valid, pos IN (0, 2) AS sel FROM p)
SELECT o_custkey, o_orderkey, CASE WHEN n < 4 THEN pos WHEN pos = 1 THEN 0 WHEN pos = 3 THEN 1 WHEN pos = 0 THEN 2 WHEN pos = 2 THEN 3 ELSE pos END AS position FROM s""")
def q_move_group(spark, sf_dir):
    """Orders of a customer as a queue: its first and third are dragged onto the fourth, where there is one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    items = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), (F.row_number().over(w) - 1).alias("position"))
    at = lambda i: F.max(F.when(F.col("position") == i, F.col("id")))
    moves = items.groupBy("o_custkey").agg(F.array(at(0), at(2)).alias("selected"), at(0).alias("active"), at(3).alias("over"))
    return queue.move_group(items, moves, "o_custkey").select("o_custkey", F.col("id").alias("o_orderkey"), "position")


@query("""
WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1)
SELECT o_custkey, list_aggregate(ids[least(2, len(ids) % 5) + 1 : greatest(2, len(ids) % 5) + 1], 'string_agg', ',') AS chosen FROM l""")
def q_range_ids(spark, sf_dir):
    lists = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    chosen = queue.range_ids(F.col("ids"), F.lit(2), F.size("ids") % 5)
    return lists.select("o_custkey", F.nullif(F.array_join(chosen.cast("array<string>"), ","), F.lit("")).alias("chosen"))


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1
  AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND x.event_id % 9 = 0) AS is_new
FROM events e WHERE event_id % 9 <> 0""")
def q_add_new(spark, sf_dir):
    """Each ninth event is there; the others are added, by user and type."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return queue.add_new(rows.where("event_id % 9 = 0"), rows.where("event_id % 9 <> 0"), ["user_id", "event_type"], "event_id").select("event_id", "is_new")


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders)
SELECT o_custkey, o_orderkey, nxt - o_orderkey - 1 AS n, o_orderkey + 1 AS first FROM n WHERE nxt - o_orderkey BETWEEN 2 AND 26""")
def q_inline_gaps(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("num"))
    return queue.inline_gaps(o, "o_custkey", "o_orderkey", "num").select("o_custkey", "o_orderkey", F.size("missing").cast("long").alias("n"), F.element_at("missing", 1).alias("first"))


@query("""
WITH e AS (SELECT *, event_type <> 'error' AS ok FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ok DESC, CASE WHEN ok THEN -event_id ELSE event_id END) AS place FROM e""")
def q_ordered_results(spark, sf_dir):
    """Successes newest first, then failures as they came."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("event_id").alias("position"), (F.col("event_type") != "error").alias("ok"))
    out = queue.ordered_results(e, e.select("user_id", "id", (-F.col("id")).alias("place")), "user_id")
    return out.select("user_id", F.col("id").alias("event_id"), "place")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '.epub' WHEN p_partkey % 3 = 1 THEN rtrim(left(repeat(p_name || 'x', 30), 120 - length(' (1-' || p_size || ')'))) || ' (1-' || p_size || ').epub'
  ELSE 'untitled (' || p_size || '-' || p_size || ').epub' END AS file, (p_size * 7 // 60) || ':' || lpad((p_size * 7 % 60)::VARCHAR, 2, '0') AS wait FROM part""")
def q_book_filename(spark, sf_dir):
    p, k, size = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")), F.col("p_partkey") % 3, F.col("p_size")
    title = F.when(k == 1, F.repeat(F.concat("p_name", F.lit("x")), F.lit(30))).when(k == 0, F.col("p_name")).otherwise(" ..")
    name = queue.book_filename(title, F.when(k == 1, 1).when(k == 2, size), size)
    return p.select("p_partkey", name.alias("file"), queue.wait_text(size * 7000 - 999).alias("wait"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Chapter ' || p_partkey WHEN 1 THEN upper(p_name) || 's ' || p_partkey WHEN 2 THEN p_name || ' -' ELSE p_partkey || '' END AS title FROM part""")
def q_clean_title(spark, sf_dir):
    """Book names as prefixes: before a dash, inside a longer word, with nothing behind them, and before a blank."""
    p, k, n = read(spark, sf_dir, "part"), F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    t = F.when(k == 0, F.concat(F.upper("p_name"), F.lit("  - Chapter "), n)).when(k == 1, F.concat(F.upper("p_name"), F.lit("s "), n)).when(k == 2, F.concat(F.col("p_name"), F.lit(" - "))).otherwise(F.concat("p_name", F.lit(" "), n))
    return p.select("p_partkey", queue.clean_title(t, F.col("p_name")).alias("title"))


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Chapter ' || p_size WHEN 1 THEN p_name ELSE 'ch ' || (p_size % 10) END AS name, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 2 THEN p_size % 10 END AS num FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY num NULLS LAST, CASE p_partkey % 3 WHEN 2 THEN 'ch 1' WHEN 0 THEN 'chapter 1' ELSE lower(name) END, p_partkey) AS pos FROM p""")
def q_auto_order(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("Chapter "), F.col("p_size").cast("string"))).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("ch "), (F.col("p_size") % 10).cast("string")))
    placed = queue.auto_order(p.select("p_partkey", name.alias("name")), "name", "p_partkey")
    return placed.select("p_partkey", F.row_number().over(Window.orderBy("place")).cast("long").alias("pos"))


@query("""
WITH n AS (SELECT p_partkey, p_partkey % 4 AS script, length(repeat('1', (p_partkey % 25 + 1)::INT) || p_size) AS k, repeat('1', (p_partkey % 25 + 1)::INT) || p_size AS digits, p_name FROM part)
SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY script, k, digits, p_partkey) AS pos FROM n""")
def q_natural_long(spark, sf_dir):
    """Runs of up to 27 digits, some behind zeros, behind letters of four scripts in both cases, with and without accents."""
    k = F.col("p_partkey")
    digits = F.concat(F.when(k % 2 == 0, "00").otherwise(""), F.repeat(F.lit("1"), (k % 25 + 1).cast("int")), F.col("p_size").cast("string"))
    letters = [["é", "e", "É"], ["ω", "Ώ", "Ω"], ["ж", "Ж", "ӝ"], ["א", "א", "א"]]
    first = F.get(F.get(F.array(*[F.array(*map(F.lit, x)) for x in letters]), (k % 4).cast("int")), (k % 3).cast("int"))
    w = Window.partitionBy("p_name").orderBy(text.natural_key(F.col("name")), "p_partkey")
    return read(spark, sf_dir, "part").withColumn("name", F.concat(first, F.lit(" "), digits)).select("p_partkey", F.row_number().over(w).alias("pos"))


# Library


def _records(spark, sf_dir):
    """Conversations as records with their turns as chapters."""
    c = read(spark, sf_dir, "conversations")
    chapter = F.struct("turn", F.col("role").alias("title"), F.array(F.struct("text")).alias("blocks"))
    made = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(chapter)).alias("c"), F.count("*").alias("n"))
    return made.select("id", (F.col("id") * 10).alias("created_at"), "n", F.transform("c", lambda x: F.struct(x["title"], x["blocks"])).alias("chapters"))


_SIZES = "WITH s AS (SELECT conv_id AS id, count(*) AS n, (2 * sum(length(role) + 16 + length(text) + 8))::BIGINT AS size FROM conversations GROUP BY 1)"


@query(_SIZES + "SELECT id, n, id % 3 <> 0 AS has_chapters, CASE WHEN id % 3 <> 0 THEN size ELSE 0 END AS chapters_size FROM s")
def q_split_records(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("chapters", F.when(F.col("id") % 3 != 0, F.col("chapters")))
    outputs, texts = library.split_records(r)
    return outputs.join(texts.select("id", F.size("chapters").alias("_n")), "id", "left").select("id", F.coalesce("_n", "n").cast("long").alias("n"), "has_chapters", "chapters_size")


@query(_SIZES + """
SELECT id, CASE WHEN id % 2 = 0 THEN -1 ELSE n END AS n, id % 3 <> 0 AS has_chapters, CASE WHEN id % 3 <> 0 THEN size ELSE 0 END AS chapters_size, CASE WHEN id % 3 <> 0 THEN n END AS stored FROM s WHERE id % 5 <> 4""")
def q_upsert_outputs(spark, sf_dir):
    """Even records come again without text, and with another count; they keep the text they had. Then each fifth goes."""
    r = _records(spark, sf_dir).withColumn("chapters", F.when(F.col("id") % 3 != 0, F.col("chapters")))
    outputs, texts = library.split_records(r)
    again = r.where("id % 2 = 0").withColumns({"n": F.lit(-1).cast("long"), "chapters": F.expr("cast(null as array<struct<title:string,blocks:array<struct<text:string>>>>)")})
    outputs, texts = library.delete_outputs(*library.upsert_outputs(outputs, texts, again), r.where("id % 5 = 4"))
    return outputs.join(texts.select("id", F.size("chapters").cast("long").alias("stored")), "id", "left").select("id", "n", "has_chapters", "chapters_size", "stored")


@query("SELECT conv_id AS id, string_agg(role || ':' || text, '|' ORDER BY turn) AS whole FROM conversations WHERE conv_id % 4 = 1 GROUP BY 1")
def q_texts_of(spark, sf_dir):
    _, texts = library.split_records(_records(spark, sf_dir))
    found = library.texts_of(texts, texts.where("id % 4 = 1"))
    return found.select("id", F.array_join(F.transform("chapters", lambda c: F.concat(c["title"], F.lit(":"), c["blocks"][0]["text"])), "|").alias("whole"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'T' || event_id END AS title FROM events WHERE event_id % 5 <> 0""")
def q_queue_snapshot(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    title = F.when(F.col("event_id") % 3 == 0, " \t").otherwise(F.concat(F.lit(" T"), F.col("event_id").cast("string"), F.lit(" ")))
    items = e.select(F.col("event_id").cast("string").alias("id"), F.lit("f").alias("name"), F.lit(1).alias("last_modified"), F.when(F.col("event_id") % 5 != 0, F.col("props").cast("binary")).alias("content"), title.alias("title"))
    return library.restored_queue(library.queue_rows(items)).select(F.col("id").cast("long").alias("event_id"), "title")


@query("""
WITH m AS (SELECT max(ts) AS now FROM events)
SELECT event_id FROM events, m WHERE event_type <> 'error' AND event_id % 4 <> 0 AND ts >= now - INTERVAL 10 DAYS AND event_id % 3 = 1""")
def q_post_cache(spark, sf_dir):
    """Events as posts: failures aren't kept, each fourth is of another version, old ones go, and each third is asked for."""
    e = read(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    rows = library.cache_rows(e.select(F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), F.lit("t").alias("title"), F.lit("").alias("html"), F.lit(None).cast("string").alias("published_at"), "ts"), now)
    rows = rows.join(e.select(F.col("event_id").alias("id"), "ts"), "id").withColumn("saved_at", F.col("ts")).withColumn("v", F.when(F.col("id") % 4 == 0, 2).otherwise(F.col("v")))
    return library.cached(library.pruned_cache(rows, now, 10), e.where("event_id % 3 = 1").select(F.col("event_id").alias("id"))).select(F.col("id").alias("event_id"))


@query("SELECT event_id, '[' || event_type || ']' AS items FROM events")
def q_string_items(spark, sf_dir):
    made = F.concat(F.lit('[1,"'), F.col("event_type"), F.lit('",null,{"a":"b"}]'))
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.array_join(library.string_items(made), ","), F.lit("]")).alias("items"))


@query("SELECT event_type, list_aggregate(list_sort(list_distinct(flatten(list(json_keys(props))))), 'string_agg', ',') AS keys FROM events GROUP BY 1")
def q_shapes(spark, sf_dir):
    return library.shapes(read(spark, sf_dir, "events"), "event_type", "props").select("event_type", F.array_join("keys", ",").alias("keys"))


# Crawls and policies


def _pages(spark, sf_dir):
    """Orders of a customer as posts, two a page; page 2 is empty for each third customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w) - 1).withColumn("page", F.expr("cast(k div 2 as int)"))
    post = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("post").alias("type"))
    made = o.groupBy(F.col("o_custkey").alias("run_id"), "page").agg(F.to_json(F.struct(F.array_sort(F.collect_list(post)).alias("data"))).alias("body"))
    return made.withColumn("body", F.when((F.col("run_id") % 3 == 0) & (F.col("page") == 2), '{"data":[]}').otherwise(F.col("body")))


_CRAWL = """
WITH o AS (SELECT o_custkey AS run_id, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 2 AS page FROM orders),
k AS (SELECT * FROM o WHERE run_id % 3 <> 0 OR page < 2)
"""


@query(_CRAWL + "SELECT run_id, o_orderkey FROM k")
def q_crawl_stop(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return feeds.crawl(feeds.parse_pages(pages), pages).select("run_id", F.col("id").cast("long").alias("o_orderkey"))


@query(_CRAWL + """
, n AS (SELECT run_id, count(*) AS posts, max(page) + 1 AS pages FROM k GROUP BY 1),
a AS (SELECT run_id, max(page) AS last FROM o GROUP BY 1),
t AS (SELECT run_id, posts, CASE WHEN run_id % 3 = 0 AND last >= 2 THEN 3 ELSE pages END AS pages, CASE WHEN run_id % 2 = 0 THEN run_id % 30 END AS e FROM n JOIN a USING (run_id))
SELECT run_id, posts, pages, coalesce(e > 0 AND (pages > ceil(e * 1.1 / 10) + 3 OR posts > e + greatest(5, 0.1 * e)), false) OR pages > CASE WHEN e > 0 THEN 1000 ELSE 60 END AS implausible,
  coalesce(e = 0 OR posts >= floor(e * 0.9), true) AS complete FROM t""")
def q_crawl_summary(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    expected = read(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("run_id"), (F.col("o_custkey") % 30).alias("expected")).distinct()
    return feeds.crawl_summary(feeds.parse_pages(pages), pages, expected)


_STATUS = "CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 410 WHEN 5 THEN 425 WHEN 6 THEN 429 WHEN 7 THEN 503 ELSE 200 END"


@query(f"""
WITH e AS (SELECT event_id, {_STATUS} AS s, event_id % 2 = 0 AS html, event_id % 9 = 8 AS failed FROM events)
SELECT event_id, CASE WHEN failed OR s IN (429, 503) THEN 'transient' WHEN s IN (401, 403) THEN CASE WHEN html THEN 'auth' ELSE 'locked' END WHEN s = 404 THEN 'missing' WHEN s >= 400 THEN 'page' WHEN html THEN 'auth' ELSE 'ok' END AS kind FROM e""")
def q_classify(spark, sf_dir):
    kind = policy.classify(F.expr(_STATUS), F.when(F.col("event_id") % 2 == 0, "Text/HTML; charset=utf-8").otherwise("application/json"), F.when(F.col("event_id") % 9 == 8, "reset"))
    return read(spark, sf_dir, "events").select("event_id", kind.alias("kind"))


@query("""
SELECT p_partkey, p_size > 0 AND p_partkey % 7 <> 0 AND (p_partkey % 2 = 0 OR abs((p_partkey % 7) - p_size) <= greatest(5, 0.05 * p_size)) AS near,
  CASE p_partkey % 5 WHEN 0 THEN 'collection-desc' WHEN 1 THEN 'collection-asc' WHEN 2 THEN 'collection-desc' ELSE 'collection' END AS listing,
  'https://x.org/api/posts?filter%5Bcollection_id%5D=' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '&sort=collection_order' ELSE '' END || '&page%5Bcount%5D=' || p_size || '&fields%5Bpost%5D=title%2Cpublished_at%2Curl%2Ccurrent_user_can_view&json-api-version=1.0' AS url FROM part""")
def q_count_match(spark, sf_dir):
    """How a listing fits what is expected, its order, and where it is asked for."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    kinds = F.when(k % 5 == 0, "published_DESC").when(k % 5 == 1, "Creator order").when(k % 5 == 2, "asc, then newest").when(k % 5 == 3, "?")
    return p.select("p_partkey", feeds.count_matches(k % 7, F.when(k % 2 != 0, F.col("p_size"))).alias("near"), feeds.order_of(kinds).alias("listing"), feeds.posts_url("https://x.org", k, k % 2 == 0, F.col("p_size")).alias("url"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
r AS (SELECT user_id, g, count(*) FILTER (NOT ok) AS n FROM e GROUP BY 1, 2),
c AS (SELECT user_id, g, n, min(g) FILTER (n >= 2) OVER (PARTITION BY user_id) AS first FROM r)
SELECT user_id, sum(CASE WHEN n < 2 OR g < first THEN 0 WHEN g = first THEN 1 + (n - 2) // 10 ELSE n // 10 END)::BIGINT AS probes FROM c GROUP BY 1 HAVING max(n) IS NOT NULL""")
def q_auth_probes(spark, sf_dir):
    """Errors of a user as auth answers: the second in a row asks for a probe, later the tenth."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "auth").otherwise("ok").alias("o"))
    return policy.due_probes(e, ["user_id"], ["event_id"], "o").groupBy("user_id").agg(F.count_if("due").alias("probes"))


_LOCKED = """
WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER w AS k, CASE WHEN event_id % 9 = 0 THEN 'ok' WHEN event_id % 3 = 0 THEN 'auth' WHEN event_id % 3 = 1 THEN 'locked' ELSE 'missing' END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (
  SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS k, false AS any_ok, false AS probed, 0 AS auth, 0 AS locked, false AS due FROM e
  UNION ALL
  SELECT user_id, event_id, k, any_ok, probed OR due, CASE WHEN due OR o = 'ok' THEN 0 ELSE auth END, CASE WHEN due OR o = 'ok' THEN 0 ELSE locked END, due
  FROM (SELECT *, coalesce(CASE o WHEN 'ok' THEN false WHEN 'auth' THEN auth >= CASE WHEN probed THEN 10 ELSE 2 END ELSE any_ok AND locked >= CASE WHEN probed THEN 10 ELSE 3 END END, false) AS due
    FROM (SELECT e.user_id, e.event_id, e.k, e.o, f.any_ok OR e.o = 'ok' AS any_ok, f.probed, f.auth + (e.o = 'auth')::INT AS auth, f.locked + (e.o IN ('locked', 'missing') AND f.any_ok)::INT AS locked FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)))
SELECT event_id, due, any_ok FROM f WHERE k > 0"""


@query(_LOCKED)
def q_locked_probes(spark, sf_dir):
    """After which answers a probe of the login is due, with locked and missing posts among them."""
    n = F.col("event_id")
    o = F.when(n % 9 == 0, "ok").when(n % 3 == 0, "auth").when(n % 3 == 1, "locked").otherwise("missing")
    return policy.due_probes(read(spark, sf_dir, "events").select("user_id", "event_id", o.alias("o")), ["user_id"], ["event_id"], "o").select("event_id", "due", "any_ok")


_ANSWERS = """
e AS (SELECT user_id, event_id, row_number() OVER w AS k, (row_number() OVER w - 1) // 12 AS request,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 IN (1, 2, 3, 4) THEN 429 WHEN event_id % 7 = 5 THEN 503 WHEN event_id % 4 = 0 THEN 404 ELSE 200 END AS status,
  CASE event_id % 5 WHEN 0 THEN 250000 WHEN 1 THEN 1000 END::BIGINT AS wait, (floor(epoch(ts))::BIGINT * 1000) AS ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
"""
_POLICY = f"""
WITH RECURSIVE {_ANSWERS},
f AS (
  SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, 1.0::DOUBLE AS slow, 0::BIGINT AS cooldown, -1::BIGINT AS request, 0 AS hits, 0::BIGINT AS waited, 0 AS tries, '' AS outcome FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, k, event_id, CASE WHEN status < 400 THEN greatest(1, slow * 0.9) WHEN outcome = 'retry' AND (status = 429 OR (status = 503 AND wait IS NOT NULL)) THEN least(8, slow * 2) ELSE slow END,
    CASE WHEN outcome = 'retry' AND (status = 429 OR (status = 503 AND wait IS NOT NULL)) THEN greatest(cooldown, ms + w) ELSE cooldown END, request, hits, waited, tries, outcome
  FROM (
    SELECT user_id, k, event_id, slow, cooldown, request, status, wait, w, ms, CASE WHEN status = 429 THEN h + 1 ELSE 0 END AS hits, CASE WHEN status = 429 AND h + 1 < 8 AND wd + w <= 600000 THEN wd + w ELSE wd END AS waited,
      CASE WHEN status < 400 OR status = 429 OR (status < 500 AND status <> 408) OR t >= 3 THEN t ELSE t + 1 END AS tries,
      CASE WHEN status < 400 THEN 'ok' WHEN status = 429 AND (h + 1 >= 8 OR wd + w > 600000) THEN 'gave_up' WHEN status = 429 THEN 'retry' WHEN (status < 500 AND status <> 408) OR t >= 3 THEN 'failed' ELSE 'retry' END AS outcome
    FROM (
      SELECT e.user_id, e.k, e.event_id, slow, cooldown, e.request, status, wait, ms, coalesce(wait, 2000 * (2 ** CASE WHEN status = 429 THEN h ELSE t END)::BIGINT) AS w, h, wd, t
      FROM (SELECT user_id, k, slow, cooldown, request, outcome, hits, waited, tries FROM f) p
      JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1,
      LATERAL (SELECT p.request = e.request AND p.outcome = 'retry' AS same) s,
      LATERAL (SELECT CASE WHEN same THEN p.hits ELSE 0 END AS h, CASE WHEN same THEN p.waited ELSE 0 END AS wd, CASE WHEN same THEN p.tries ELSE 0 END AS t) u)))
SELECT event_id, round(slow, 6) AS slow, cooldown, hits, waited, outcome FROM f WHERE k > 0"""


def _answers(spark, sf_dir):
    """Events as answers: twelve of a user's to a request, 429s, 503s, other refusals, successes and failures of the network."""
    w, n = Window.partitionBy("user_id").orderBy("event_id"), F.col("event_id") % 7
    status = F.when(n == 0, None).when(n.isin(1, 2, 3, 4), 429).when(n == 5, 503).when(F.col("event_id") % 4 == 0, 404).otherwise(200)
    wait = F.when(F.col("event_id") % 5 == 0, 250_000).when(F.col("event_id") % 5 == 1, 1000).cast("long")
    e = read(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.expr("cast((row_number() over (partition by user_id order by event_id) - 1) div 12 as long)").alias("request"), (F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).alias("at"), status.cast("int").alias("status"), wait.alias("wait_ms"))


@query(_POLICY)
def q_slowdown(spark, sf_dir):
    """How slow a run is and until when it is held, and what its requests have waited for, after each answer."""
    return policy.slowdowns(_answers(spark, sf_dir), "user_id", ["event_id"]).select("event_id", F.round("slow", 6).alias("slow"), "cooldown", "hits", "waited", "outcome")


# Styles and packages


def _configs(spark, sf_dir):
    """A rule set of each part: one rarity, one keyword with a glow, percentages, a panel that tries to break out."""
    p = spread(read(spark, sf_dir, "part").select("p_partkey"))
    color = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0")))
    style = lambda glow, bold: F.struct(color.alias("color"), F.lit(glow).alias("glow"), bold.alias("bold"))
    group = lambda key, s: F.array(F.struct(F.lit(key).alias("key"), F.lit("L").alias("label"), F.array(F.lit(" W ")).alias("words"), s.alias("style")))
    percent = F.struct(color.alias("low"), F.lit("#123").alias("mid"), F.lit("#FFFFFF").alias("high"))
    sheet = F.struct(F.lit("red;}").alias("border"), F.lit("transparent").alias("background"), (F.col("p_partkey") % 2 == 0).alias("rounded"))
    json = F.to_json(F.struct(group("a", style("", F.col("p_partkey") % 3 == 0)).alias("rarities"), group("b", style("0 0 4px #fff", F.lit(False))).alias("keywords"), percent.alias("percent"), sheet.alias("statSheet")))
    broken = F.when(F.col("p_partkey") % 11 == 0, F.replace(json, F.lit('"key":"b"'), F.lit('"key":"1b"'))).when(F.col("p_partkey") % 13 == 0, F.replace(json, F.lit('"rounded":'), F.lit('"rounded":1,"r":'))).otherwise(json)
    return palette.validate(p.select("p_partkey", broken.alias("json")))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'keywords[0]: invalid "key" "1b" (letters, digits, - and _ only)' WHEN p_partkey % 13 = 0 THEN 'statSheet.rounded must be a boolean' END AS error FROM part""")
def q_validate(spark, sf_dir):
    return _configs(spark, sf_dir).select("p_partkey", "error")


@query("""
WITH p AS (SELECT p_partkey, '#' || lower(lpad(printf('%X', (p_partkey * 7919) % 16777216), 6, '0')) AS c FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0)
SELECT p_partkey, '.stat-sheet{margin:1em 0;padding:0.55em 0.85em;border:1px solid currentColor;border-radius:' || CASE WHEN p_partkey % 2 = 0 THEN '8px' ELSE '0' END || ';background:transparent;font-size:0.95em;line-height:1.5;}' AS first,
  '.rarity-a{color:' || c || ';font-weight:' || CASE WHEN p_partkey % 3 = 0 THEN 600 ELSE 400 END || ';}' AS rarity, '.kw-b{color:' || c || ';text-shadow:0 0 4px #fff;letter-spacing:0.02em;font-weight:700;}' AS keyword, 12 AS n FROM p""")
def q_css(spark, sf_dir):
    lines = F.split(palette.css(F.col("config")), "\n")
    return _configs(spark, sf_dir).where("ok").select("p_partkey", F.element_at(lines, 1).alias("first"), F.element_at(lines, -2).alias("rarity"), F.element_at(lines, -1).alias("keyword"), F.size(lines).alias("n"))


@query("SELECT p_partkey, true AS same, true AS legible, true AS bare FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0")
def q_config_round_trip(spark, sf_dir):
    """Exported rule sets read back alike; fixed ones show on both pages; border-only panels have no fill."""
    from folio.operators.rules import check_color

    c = _configs(spark, sf_dir).where("ok").select("p_partkey", "config", palette.config_json(F.col("config")).alias("json"))
    again = palette.validate(c.select("p_partkey", F.col("config").alias("was"), "json"))
    fixed = palette.fix_config(again.withColumn("bare", palette.border_only(F.col("config"))))
    legible = check_color(F.col("config")["rarities"][0]["style"]["color"])["ok"] & check_color(F.col("config")["percent"]["high"])["ok"]
    return fixed.select("p_partkey", (F.to_json("was") == F.to_json("bare")).alias("same"), legible.alias("legible"), (F.col("bare")["stat_sheet"]["background"] == "transparent").alias("bare"))


@query("""
SELECT p_partkey, '<!DOCTYPE html>' || chr(10) || '<html class="' || p_brand || '" xml:lang="de" lang="de"><head><meta charset="utf-8" /><title>' || p_partkey || '</title>' || chr(9) || '<link rel="stylesheet" type="text/css" href="style.css" />' || chr(10) || '</head></html>' AS page,
  '<package version="3.0"><metadata><dc:title>' || p_partkey || '</dc:title><dc:language>de</dc:language>' || chr(9) || chr(9) || '<meta property="dcterms:modified">1980-01-01T00:00:00Z</meta>' || chr(10) || chr(9) || '</metadata><manifest><item id="cover-image" href="c" properties="cover-image" />'
  || chr(9) || chr(9) || '<item id="rarity-css" href="style.css" media-type="text/css" />' || chr(10) || chr(9) || chr(9) || '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav" />' || chr(10) || chr(9) || '</manifest></package>' AS opf FROM part""")
def q_upgrade(spark, sf_dir):
    """Pages and package documents of older packages."""
    n = F.col("p_partkey").cast("string")
    page = F.concat(F.when(F.col("p_partkey") % 2 == 0, '<!DOCTYPE html PUBLIC "x" "y">\n').otherwise(""), F.lit('<html xml:lang="en" class="'), F.col("p_brand"), F.lit('"><head><meta http-equiv="Content-Type" content="x"><title>'), n, F.lit("</title></head></html>"))
    opf = F.concat(F.lit('<package version="2.0"><metadata><dc:title opf:role="x">'), n, F.lit('</dc:title><dc:language>en</dc:language></metadata><manifest><item id="cover-image" href="c"/></manifest></package>'))
    entry = lambda name, c: packages.upgrade_entry(F.lit(name), c.cast("binary"), "de").cast("string")
    return read(spark, sf_dir, "part").select("p_partkey", entry("OEBPS/a.xhtml", page).alias("page"), entry("OEBPS/content.opf", opf).alias("opf"))
