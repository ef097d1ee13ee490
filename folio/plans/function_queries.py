"""Queries of single functions over whole tables, several to a query, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import layout, markup, palette, queue, retention, rules, sequence, sheets
from folio.plans.registry import query, read
from folio.runtime import written
from folio.sources import feeds, packages

# Names and texts


@query("""
SELECT * EXCLUDE (shape0) FROM (
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || ': ' || p_name WHEN 1 THEN p_partkey || ' of ' || p_size ELSE 'x' END AS expanded,
  p_brand || ' ' || lpad(greatest(1, p_size // 2)::VARCHAR, greatest(2, length(greatest(1, p_size // 2)::VARCHAR))::INT, '0') || ' — ' || p_name AS series,
  CASE WHEN p_partkey % 7 <= 5 THEN array_to_string(list_transform(range(0, p_partkey % 7), lambda i: 'n' || i), ', ') ELSE 'n0, n1, n2, n3, n4 and 1 more' END AS brief,
  'a b' || p_partkey AS clean, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'y.org' END || '/a/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '?k[1]&b' ELSE '' END AS shape0, CASE WHEN p_partkey % 3 = 2 THEN '(bad url)' ELSE shape0 END AS shape FROM part)""")
def q_names(spark, sf_dir):
    """Patterns of new names, titles in a series, brief lists, XML's forbidden characters, and shapes of addresses."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    n = k.cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("Chapter "), F.col("p_size").cast("string"), F.lit(".pdf"))).otherwise("none.pdf")
    pattern = F.when(k % 3 == 0, F.concat(F.lit(" {num}: "), F.col("p_name"))).when(k % 3 == 1, F.concat(F.lit("{n} of "), F.col("p_size").cast("string"))).otherwise(" x\t")
    url = F.concat(F.when(k % 3 == 0, "https://x.org").when(k % 3 == 1, "https://y.org").otherwise("not a "), F.lit("/a/"), n, F.when(k % 2 == 0, "?k%5B1%5D=secret&b=2&b=3").otherwise("#f"))
    return p.select(
        "p_partkey", sequence.expand_pattern(pattern, k, name).alias("expanded"), text.series_title(F.concat(F.lit(" "), F.col("p_brand")), F.col("p_size") / 2, F.concat("p_name", F.lit(" "))).alias("series"),
        text.brief_list(F.transform(F.filter(F.sequence(F.lit(0), (k % 7).cast("int")), lambda i: i < k % 7), lambda i: F.concat(F.lit("n"), i.cast("string")))).alias("brief"),
        text.sanitize_xml(F.concat(F.lit("a\x00 \x0bb￾\x1f"), n)).alias("clean"), text.url_shape(url, "x.org").alias("shape"),
    )


@query("""
SELECT doc_id, md5(trim(regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g'))) AS bare, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, text LIKE '%[%[%' AS dense, md5(text) AS decoded FROM documents""")
def q_texts(spark, sf_dir):
    """Whole texts: bullets taken off, markup escaped and, as numbers in both bases, decoded again, brackets counted."""
    d = read(spark, sf_dir, "documents")
    numbered = F.regexp_replace(F.regexp_replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), "e", "&#x65;"), "o", "&#0111;")
    return d.select("doc_id", F.md5(text.strip_bullet(F.concat(F.lit("• \t"), "text"))).alias("bare"), F.md5(text.escape_html(F.col("text"))).alias("escaped"), (sheets.brackets(F.col("text")) >= 2).alias("dense"), F.md5(markup.decode_entities(numbered)).alias("decoded"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written, floor(epoch(ts))::BIGINT * 1000 AS published, CASE event_id % 4 WHEN 0 THEN least(300000, event_id * 1000)::DOUBLE WHEN 1 THEN least(300000, event_id % 400 * 1000)::DOUBLE WHEN 2 THEN 0 END AS wait,
  event_id % 5 < 2 AS recent FROM events""")
def q_times(spark, sf_dir):
    """Times as packages write them and as listings do, what an answer asks to wait for, and whether a saved row is still good."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    now = F.date_trunc("second", ts)
    http = lambda t: F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    later = F.timestamp_seconds(F.unix_seconds(now) + k % 400)
    header = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, http(later)).when(k % 4 == 2, "-5").otherwise("soon")
    saved = e.withColumn("saved", F.timestamp_seconds(F.unix_seconds(F.lit("2024-06-30").cast("timestamp")) - (k % 5) * 20 * 86400))
    old = retention.expired(saved, "saved", F.lit("2024-06-30").cast("timestamp")).select("event_id", F.lit(False).alias("r"))
    iso = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    made = e.select("event_id", text.utc_seconds(ts).alias("written"), feeds.published_ms(iso).alias("published"), text.retry_after_ms(header, now).alias("wait"))
    return made.join(old, "event_id", "left").select("event_id", "written", "published", "wait", F.coalesce("r", F.lit(True)).alias("recent"))


# Listings


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'A | B ' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'Name' END AS title, CASE WHEN o_orderkey % 3 < 2 THEN 'Al ' || o_custkey END AS creator,
  CASE WHEN o_orderkey % 3 = 0 THEN 1000 + o_orderkey % 1000 WHEN o_orderkey % 3 = 2 THEN o_orderkey END::INT AS n, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey::VARCHAR END AS id, o_orderkey % 5 IN (0, 1) AS allowed,
  CASE o_orderkey % 4 WHEN 0 THEN 'https://x.org/b' WHEN 1 THEN 'https://x.org/c?d' END AS same, 'https://x.org/api/posts/' || o_orderkey || '?fields%5Bpost%5D=title%2Ccontent%2Ccontent_json_string%2Cpublished_at%2Ccurrent_user_can_view&json-api-version=1.0' AS url FROM orders""")
def q_listing_texts(spark, sf_dir):
    """Titles of listings taken apart, ids in paths, hosts that covers may come from, and links of one origin."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    n = k.cast("string")
    creator = F.concat(F.lit("Collection from Al "), F.col("o_custkey").cast("string"))
    title = F.when(k % 3 == 0, F.concat(F.lit("A | B "), n, F.lit(" | "), creator, F.lit(" | 1."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" posts | Site"))).when(k % 3 == 1, F.concat(F.lit("Name | "), creator, F.lit("|Site")))
    title = title.otherwise(F.concat(F.lit("3 Words | "), n, F.lit(" Beiträge | Site")))
    path = F.when(k % 4 == 0, F.concat(F.lit("/collection/a-name-"), n, F.lit("/"))).when(k % 4 == 1, F.concat(F.lit("/c/x/collection/"), n)).when(k % 4 == 2, F.concat(F.lit("/posts/"), n)).otherwise("/collection/name")
    cover = F.when(k % 5 == 0, "https://x.org/a.png").when(k % 5 == 1, "https://c10.cdn.org/a").when(k % 5 == 2, "http://x.org/a").when(k % 5 == 3, "https://x.org.evil.net/a").otherwise("no url")
    link = F.when(k % 4 == 0, "/b").when(k % 4 == 1, "https://x.org/c?d").when(k % 4 == 2, "//y.org/b").otherwise("https://x.organ/b")
    t = feeds.listing_title(title)
    return o.select(
        "o_orderkey", t["title"].alias("title"), t["creator"].alias("creator"), t["count"].alias("n"), feeds.numeric_id(path, "collection").alias("id"), feeds.allowed_url(cover, ["x.org"], [".cdn.org"]).alias("allowed"),
        feeds.same_origin(link, "https://x.org").alias("same"), feeds.post_url("https://x.org", n).alias("url"),
    )


@query("""
WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids, min(o_orderkey) AS lo FROM orders GROUP BY 1)
SELECT o_custkey, len(ids) > 0 AND (o_custkey % 3 <> 0 OR lo % 2 = 0) AND (o_custkey % 4 = 0 OR len(ids) <= o_custkey % 6 + 5) AS plausible,
  array_to_string(list_concat([lo], list_filter(ids, lambda i: i <> lo)), ',') AS chosen, array_to_string(ids[2:4], ',') AS slice FROM l""")
def q_listing_checks(spark, sf_dir):
    """Whether listings can be what was asked for, what a selection is with more selected, and slices by position."""
    o = read(spark, sf_dir, "orders")
    lists = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    low = F.get("ids", F.lit(0))
    seen = F.when(F.col("o_custkey") % 3 == 0, F.array(F.when(low % 2 == 0, low).otherwise(F.lit(-1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    expected = F.when(F.col("o_custkey") % 4 != 0, (F.col("o_custkey") % 6).cast("int"))
    rows = o.select("o_custkey", "o_orderkey", F.expr("row_number() over (partition by o_custkey order by o_orderkey) - 1").alias("position"))
    some = queue.between(rows, "position", 1, 3).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda i: i.cast("string")), ",").alias("slice"))
    made = lists.select("o_custkey", feeds.plausible(F.col("ids"), seen, expected).alias("plausible"), F.array_join(F.transform(queue.added_selection(F.array(low), F.col("ids")), lambda i: i.cast("string")), ",").alias("chosen"))
    return made.join(some, "o_custkey", "left").select("o_custkey", "plausible", "chosen", F.coalesce("slice", F.lit("")).alias("slice"))


# Sheets, colours, covers


@query("""
WITH l AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ') AS t, doc_id % 8 AS k FROM documents)
SELECT doc_id, k IN (0, 1, 2, 3, 4) AS stat, k IN (1, 2, 3) AS strong, CASE WHEN k = 3 THEN 3 WHEN k = 7 THEN 2 WHEN k < 7 AND t = '' AND k > 4 THEN 0 ELSE 1 END AS fields FROM l""")
def q_stat_like(spark, sf_dir):
    """Which texts belong to a sheet, and which of them strongly: bullets, brackets, percentages, known labels, fields."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    k = F.col("doc_id") % 8
    t = F.when(k == 0, F.concat(F.lit("a [b] [c] "), plain)).when(k == 1, F.concat(F.lit("5% of 7% "), plain)).when(k == 2, F.concat(F.lit("Reactor "), plain)).when(k == 3, F.concat(F.lit("Power: 1 Range: 2 Hit: "), plain))
    t = t.when(k == 4, F.concat(F.lit("x "), plain)).when(k == 7, F.concat(F.lit("Power: 1 Range: "), plain)).otherwise(plain)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(k == 4, "li").otherwise("p").alias("type"), F.lit(None).cast("string").alias("role"), t.alias("text"))
    seen = sheets.with_fields(rows)
    return seen.select("doc_id", sheets.is_stat_like(F.col("fields")).alias("stat"), sheets.is_strong(F.col("fields")).alias("strong"), F.size("fields").alias("fields"))


@query("""
WITH c AS (SELECT p_partkey, ((p_partkey * 7919) % 256) AS r, ((p_partkey * 104729) % 256) AS g, ((p_partkey * 1299709) % 256) AS b FROM part),
m AS (SELECT *, r / 255.0 AS x, g / 255.0 AS y, b / 255.0 AS z, greatest(r, g, b) / 255.0 AS hi, least(r, g, b) / 255.0 AS lo FROM c)
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '0 0 4px rgba(120,120,120,0.5)' ELSE '0 0 4px rgba(' || r || ',' || g || ',' || b || ',0.6)' END AS glow,
  round(CASE WHEN hi = lo THEN 0 WHEN x = hi THEN (y - z) / (hi - lo) + CASE WHEN y < z THEN 6 ELSE 0 END WHEN y = hi THEN (z - x) / (hi - lo) + 2 ELSE (x - y) / (hi - lo) + 4 END / 6, 6) AS h,
  round(CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / CASE WHEN (hi + lo) / 2 > 0.5 THEN 2 - hi - lo ELSE hi + lo END END, 6) AS s, round((hi + lo) / 2, 6) AS l, least(p_partkey * 8000000 // 10, 536870912)::BIGINT AS budget, p_partkey % 3 < 2 AND p_partkey % 5 > 0 AS cover FROM m""")
def q_colors(spark, sf_dir):
    """Glows, hues, byte budgets, and covers by their first bytes and sizes."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    c = F.format_string("#%02x%02x%02x", (k * 7919) % 256, (k * 104729) % 256, (k * 1299709) % 256)
    hsl = palette.hsl(c)
    content = F.concat(F.when(k % 3 == 0, F.lit(b"\xff\xd8\xff\xe0")).when(k % 3 == 1, F.lit(b"\x89PNG")).otherwise(F.lit(b"GIF8")), F.encode(F.repeat(F.lit("x"), F.when(k % 5 == 0, 100).otherwise(10)), "UTF-8"))
    return p.select(
        "p_partkey", palette.glow_for(F.when(k % 10 == 0, "none").otherwise(c)).alias("glow"), F.round(hsl["h"], 6).alias("h"), F.round(hsl["s"], 6).alias("s"), F.round(hsl["l"], 6).alias("l"),
        retention.byte_budget(k * 1_000_000).cast("long").alias("budget"), packages.accepts_cover(content, 50).alias("cover"),
    )


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'rarity' WHEN 1 THEN 'keyword' ELSE 'percent' END AS scope, lum_w >= 2.5 AND lum_b >= 2.5 AS ok FROM (
  SELECT p_partkey, 1.05 / (y + 0.05) AS lum_w, (y + 0.05) / 0.05 AS lum_b FROM (
    SELECT p_partkey, list_sum([[0.2126, 0.7152, 0.0722][i] * CASE WHEN v[i] <= 0.03928 THEN v[i] / 12.92 ELSE pow((v[i] + 0.055) / 1.055, 2.4) END FOR i IN [1, 2, 3]]) AS y
    FROM (SELECT p_partkey, [((p_partkey * 7919) % 256) / 255.0, ((p_partkey * 104729) % 256) / 255.0, ((p_partkey * 1299709) % 256) / 255.0] AS v FROM part)))""")
def q_audit(spark, sf_dir):
    """Colours of rule sets, and whether both pages show them."""
    k = F.col("p_partkey")
    scope = F.when(k % 4 == 0, "rarity").when(k % 4 == 1, "keyword").otherwise("percent")
    rows = read(spark, sf_dir, "part").select("p_partkey", scope.alias("scope"), F.format_string("#%02x%02x%02x", (k * 7919) % 256, (k * 104729) % 256, (k * 1299709) % 256).alias("color"))
    return palette.audit(rows).select("p_partkey", "scope", "ok")


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, pg, array_to_string(w[pg * 400 + 1 : pg * 400 + 400], ' ') AS t, (len(w) + 399) // 400 AS n FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 399) // 400)) AS pg FROM d)),
b AS (SELECT doc_id, pg, 0 AS k, 'Head of the book ' || (pg + 1) AS t FROM p WHERE n < 3 UNION ALL SELECT doc_id, pg, 1, t FROM p),
s AS (SELECT *, CASE WHEN lag(pg) OVER v <> pg AND NOT regexp_matches(lag(t) OVER v, '[.!?…"”’''\\]]$') AND regexp_matches(t, '^\\p{Ll}') THEN 0 ELSE 1 END AS st FROM b WINDOW v AS (PARTITION BY doc_id ORDER BY pg, k)),
i AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY pg, k) AS block FROM s)
SELECT doc_id, block::BIGINT AS block_no, md5(string_agg(t, ' ' ORDER BY pg, k)) AS text, 'p' AS type FROM i GROUP BY doc_id, block""")
def q_chapter_blocks(spark, sf_dir):
    """Documents set in pages of fifty lines, in shuffled order of arrival, each under a running head and over its number: from
    glyphs to the blocks of chapters, heads and numbers off, and pages stitched. Head and foot have two lines each, as many as
    count as a page's edge: a line of text there that is a number alone, or repeats on most pages, would be taken for one of them."""
    docs, every = read(spark, sf_dir, "documents"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    file_id = F.col("doc_id").cast("string").alias("file_id")
    words = docs.select("doc_id", file_id, every.alias("w")).select("doc_id", "file_id", F.posexplode("w").alias("i", "w"))
    page = (F.floor(F.col("i") / 400) + 1).cast("int")
    glyph = lambda s, x, y: [s.alias("str"), (F.length(s) * 5.0).alias("width"), F.lit(10.0).alias("height"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), x, y.cast("double")).alias("transform")]
    shuffled = F.pmod(F.xxhash64("doc_id", "i"), F.lit(1 << 30)).cast("int").alias("glyph_no")
    body = words.select("file_id", page.alias("page_no"), shuffled, *glyph(F.col("w"), (F.col("i") % 8) * 1000.0, -40.0 - 12.0 * F.floor((F.col("i") % 400) / 8)))
    n_pages = F.ceil(F.size(every) / 400).cast("int")
    pages = written(docs.select("doc_id", n_pages.alias("n")).where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page_no")).distinct(), tidy=True)
    number = F.col("page_no").cast("string")
    marks = [
        (-1, F.concat(F.lit("Head of the book "), number), 0.0), (-3, F.concat(F.lit("Page "), number, F.lit(" of 99")), -12.0),
        (-2, number, -900.0), (-4, F.concat(number, F.lit(" / 99")), -880.0),
    ]
    around = pages.select(file_id, "page_no", F.inline(F.array(*[F.struct(F.lit(k).alias("glyph_no"), *glyph(s, F.lit(0.0), F.lit(y))) for k, s, y in marks])))
    counts = pages.groupBy(file_id).agg(F.count("*").alias("n_pages"))
    blocks = layout.chapter_blocks(body.unionByName(around), counts)
    return blocks.select(F.col("file_id").cast("long").alias("doc_id"), F.col("block_no").cast("long").alias("block_no"), F.md5("text").alias("text"), "type")


# Marks


@query("""
WITH w AS (SELECT doc_id, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS k, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents),
n AS (SELECT *, lag(w) OVER v AS before, lead(w) OVER v AS after FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, md5(string_agg(CASE WHEN k % 4 = 0 AND lower(w) = 'the' THEN '<span class="rarity-zzq">[' || w || ']</span>' WHEN k % 4 = 0 THEN '[' || w || ']' WHEN lower(w) = 'of' AND k % 4 <> 3 AND lower(after) = 'the' THEN '<span class="kw-k">' || w || ' ' || after || '</span>'
  WHEN lower(w) = 'the' AND k % 4 <> 1 AND lower(before) = 'of' THEN NULL ELSE w END, ' ' ORDER BY k)) AS html FROM n GROUP BY doc_id""")
def q_marked_words(spark, sf_dir):
    """All words of each document, each fourth in brackets: known ones are marked there, and a phrase where it stands outside."""
    r = rules.Rules(rarities=[("zzq", ["the"])], keywords=[("k", ["of the"])], percent=False)
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    d = read(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    marked = F.array_join(F.transform("w", lambda w, i: F.when(i % 4 == 3, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")
    return d.select("doc_id", F.md5(rules.tag_keywords(rules.tag_rarities(marked, r), r)).alias("html"))
