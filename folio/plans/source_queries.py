"""Queries of packages, files, listings, streams of requests and dictionaries over the test tables, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import automaton, library, sheets, versions, vocabulary
from folio.plans.library_queries import _CRAWL, _POLICY, _answers, _pages
from folio.plans.registry import query, read
from folio.runtime import scratch
from folio.sources import archives, chapters, feeds, filesource, listings, packages, resources
from folio.streaming import policy, requests

# Packages

_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def _old_packages(spark, sf_dir):
    """Conversations as packages of the older format, turns as pages: the mimetype somewhere inside and deflated, play orders
    that are all alike, document types and named entities. Some lack a map, its points or a language; some are cut off."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), "role", "text", F.expr("cast(row_number() over (partition by conv_id order by turn) - 1 as string)").alias("n"))
    book, n = F.col("book_id"), F.col("n")
    page = F.concat(F.lit('<html xml:lang="en"><head><title>'), n, F.lit("</title></head><body><p>"), text.escape_xml(F.col("text")), F.lit("</p></body></html>"))
    pages = c.select("book_id", (n.cast("long") + 5).alias("ord"), F.concat(F.lit("OEBPS/page-"), n, F.lit(".html")).alias("path"), page.alias("content"))
    point = F.concat(F.lit('<navPoint id="p'), n, F.lit('" playOrder="1"><navLabel><text>'), F.col("role"), F.lit("&nbsp;"), n, F.lit('</text></navLabel><content src="OEBPS/page-'), n, F.lit('.html"/></navPoint>'))
    points = c.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.cast("long").alias("n"), point.alias("p")))), lambda x: x["p"]), "").alias("points"))
    ncx = F.concat(F.lit('<?xml version="1.0"?>\n<!DOCTYPE ncx PUBLIC "-//NISO//DTD ncx 2005-1//EN" "ncx.dtd">\n<ncx><navMap>'), F.when(book % 11 != 0, F.col("points")).otherwise(""), F.lit("</navMap></ncx>"))
    language = F.when(book % 13 != 0, "<dc:language>en</dc:language>").otherwise("")
    opf = F.concat(F.lit('<package version="2.0" unique-identifier="b"><metadata><dc:title opf:role="x">T&nbsp;U</dc:title>'), language, F.lit('<dc:date>2020-05-06T07:08:09.123Z</dc:date></metadata><manifest><item id="cover-image" href="OEBPS/a.png" media-type="image/png"/></manifest><spine toc="ncx"/><guide></guide></package>'))
    row = lambda o, p, content, when=F.lit(True): F.when(when, F.struct(F.lit(o).cast("long").alias("ord"), F.lit(p).alias("path"), content.alias("content")))
    rest = F.array(
        row(0, "META-INF/container.xml", F.concat(F.lit("c"), book.cast("string"))), row(1, "book.opf", opf), row(2, "toc.ncx", ncx, book % 5 != 0), row(3, "mimetype", F.lit("application/epub+zip")),
        row(4, "OEBPS/front-cover.html", F.lit("<html><head></head></html>"), book % 3 == 0), row(1 << 30, "OEBPS/a.png", F.lit("\x01\x02")),
    )
    others = points.select("book_id", F.explode(F.filter(rest, lambda r: r.isNotNull())).alias("r")).select("book_id", "r.*")
    made = packages.zip_books(pages.unionByName(others).select("book_id", "ord", "path", F.col("content").cast("binary").alias("content"), F.lit(False).alias("stored")))
    return made.withColumn("package", F.when(F.col("book_id") % 7 == 0, F.expr("substring(package, 1, 40)")).otherwise(F.col("package")))


_REPACKAGED = f"""
WITH c AS (SELECT conv_id AS book_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
b AS (SELECT book_id, count(*) AS pages, CASE WHEN book_id % 7 = 0 THEN 'File is not a zip file' WHEN book_id % 5 = 0 THEN 'the package has no navigation map' WHEN book_id % 11 = 0 THEN 'the navigation map has no points'
    WHEN book_id % 13 = 0 THEN 'anchor not found: dc:language' END AS error,
  string_agg('<navPoint id="p' || n || '" playOrder="' || (n + 1) || '"><navLabel><text>' || role || '&nbsp;' || n || '</text></navLabel><content src="OEBPS/page-' || n || '.html"/></navPoint>', '' ORDER BY n) AS points,
  string_agg(chr(9) || chr(9) || chr(9) || '<li><a href="page-' || n || '.html">' || role || '&nbsp;' || n || '</a></li>', chr(10) ORDER BY n) AS links FROM c GROUP BY 1),
e AS (
  SELECT book_id, 0 AS o, 'mimetype' AS path, 'application/epub+zip' AS content FROM b
  UNION ALL SELECT book_id, 1, 'META-INF/container.xml', 'c' || book_id FROM b
  UNION ALL SELECT book_id, 2, 'book.opf', '<package version="3.0" unique-identifier="b"><metadata><dc:title>T&nbsp;U</dc:title><dc:language>de</dc:language><dc:date>2020-05-06T07:08:09Z</dc:date>' || chr(9) || chr(9)
    || '<meta property="dcterms:modified">1980-01-01T00:00:00Z</meta>' || chr(10) || chr(9) || '</metadata><manifest><item id="cover-image" href="OEBPS/a.png" media-type="image/png" properties="cover-image" />' || chr(9) || chr(9)
    || '<item id="rarity-css" href="OEBPS/style.css" media-type="text/css" />' || chr(10) || chr(9) || chr(9) || '<item id="nav" href="OEBPS/nav.xhtml" media-type="application/xhtml+xml" properties="nav" />' || chr(10) || chr(9)
    || '</manifest><spine toc="ncx"/><guide>' || chr(9) || chr(9) || '<reference type="text" title="Start" href="OEBPS/page-0.html" />' || chr(10) || chr(9) || '</guide></package>' FROM b
  UNION ALL SELECT book_id, 3, 'toc.ncx', '<?xml version="1.0"?>' || chr(10) || '<!DOCTYPE ncx PUBLIC "-//NISO//DTD ncx 2005-1//EN" "ncx.dtd">' || chr(10) || '<ncx><navMap>' || points || '</navMap></ncx>' FROM b
  UNION ALL SELECT book_id, 4, 'OEBPS/front-cover.html', '<!DOCTYPE html>' || chr(10) || '<html xml:lang="de" lang="de"><head>' || chr(9) || '<link rel="stylesheet" type="text/css" href="style.css" />' || chr(10) || '</head></html>' FROM b WHERE book_id % 3 = 0
  UNION ALL SELECT book_id, 5 + n, 'OEBPS/page-' || n || '.html', '<!DOCTYPE html>' || chr(10) || '<html xml:lang="de" lang="de"><head><title>' || n || '</title>' || chr(9) || '<link rel="stylesheet" type="text/css" href="style.css" />' || chr(10)
    || '</head><body><p>' || {_ESCAPED.format("text")} || '</p></body></html>' FROM c
  UNION ALL SELECT book_id, 1000000, 'OEBPS/a.png', chr(1) || chr(2) FROM b
  UNION ALL SELECT book_id, 1000001, 'OEBPS/style.css', '.x{{}}' FROM b
  UNION ALL SELECT book_id, 1000002, 'OEBPS/nav.xhtml', '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="de" lang="de">' || chr(10) || chr(10)
    || '<head>' || chr(10) || chr(9) || '<meta charset="utf-8" />' || chr(10) || chr(9) || '<title>Table of Contents</title>' || chr(10) || chr(9) || '<link rel="stylesheet" type="text/css" href="style.css" />' || chr(10) || '</head>' || chr(10) || chr(10) || '<body>' || chr(10)
    || chr(9) || '<nav epub:type="toc" id="toc">' || chr(10) || chr(9) || chr(9) || '<h1>Table of Contents</h1>' || chr(10) || chr(9) || chr(9) || '<ol>' || chr(10) || links || chr(10) || chr(9) || chr(9) || '</ol>' || chr(10) || chr(9) || '</nav>' || chr(10)
    || chr(10) || chr(9) || '<nav epub:type="landmarks" id="landmarks" hidden="">' || chr(10) || chr(9) || chr(9) || '<h2>Guide</h2>' || chr(10) || chr(9) || chr(9) || '<ol>' || chr(10)
    || CASE WHEN book_id % 3 = 0 THEN chr(9) || chr(9) || chr(9) || '<li><a epub:type="cover" href="front-cover.html">Cover</a></li>' || chr(10) ELSE '' END
    || chr(9) || chr(9) || chr(9) || '<li><a epub:type="bodymatter" href="page-0.html">Start of Content</a></li>' || chr(10) || chr(9) || chr(9) || '</ol>' || chr(10) || chr(9) || '</nav>' || chr(10) || '</body>' || chr(10) || chr(10) || '</html>' || chr(10) FROM b)
SELECT e.book_id, row_number() OVER (PARTITION BY e.book_id ORDER BY o) - 1 AS ord, path, md5(content) AS h, path = 'mimetype' AS stored, NULL AS error FROM e JOIN b ON b.book_id = e.book_id WHERE b.error IS NULL
UNION ALL SELECT book_id, NULL, NULL, NULL, NULL, error FROM b WHERE error IS NOT NULL"""


@query(_REPACKAGED)
def q_repackage(spark, sf_dir):
    """Packages of the older format opened, rewritten as a whole, zipped and opened again: every entry in its place, by the
    digest of its content, and what is wrong with those that can't be rewritten."""
    made, failed = archives.repackaged(archives.opened(_old_packages(spark, sf_dir)), ".x{}", "de")
    again = archives.opened(packages.zip_books(made)).select("book_id", F.col("ord").cast("long").alias("ord"), "path", F.md5("content").alias("h"), "stored", "error")
    return again.unionByName(failed, allowMissingColumns=True)


@query("""
SELECT conv_id::VARCHAR AS book_id, 0::BIGINT AS ord, 'mimetype' AS path, md5('application/epub+zip') AS h, true AS stored FROM conversations GROUP BY 1
UNION ALL SELECT conv_id::VARCHAR, row_number() OVER (PARTITION BY conv_id ORDER BY turn), 'OEBPS/t' || turn || '.txt', md5(text), false FROM conversations""")
def q_package_files(spark, sf_dir):
    """Conversations written by the package sink, twice, of which the second time counts, and read back entry by entry."""
    c = read(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").alias("book_id"), (F.col("turn") + 1).cast("long").alias("ord"), F.concat(F.lit("OEBPS/t"), F.col("turn").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), F.lit(False).alias("stored"))
    heads = c.select(F.col("conv_id").alias("book_id")).distinct().select("book_id", F.lit(-1).cast("long").alias("ord"), F.lit("mimetype").alias("path"), F.lit("application/epub+zip").cast("binary").alias("content"), F.lit(True).alias("stored"))
    path = scratch(spark)
    filesource.write_packages(heads, path)
    filesource.write_packages(turns.unionByName(heads), path, "overwrite")
    back = archives.opened(filesource.read_written(spark, path))
    return back.select("book_id", F.col("ord").cast("long").alias("ord"), "path", F.md5("content").alias("h"), "stored")


# Files


@query("""
WITH l AS (SELECT doc_id % 8 AS folder, unnest(string_split(text, chr(10))) AS l FROM documents),
k AS (SELECT * FROM l WHERE regexp_matches(l, '[^\\s\\x1c-\\x1f\\x85\\xa0]'))
SELECT folder::VARCHAR AS folder, NULL AS error, count(*) AS fragments, sum(length(l))::BIGINT AS chars FROM k GROUP BY 1
UNION ALL SELECT 'bad', 'not a text file', 0, NULL UNION ALL SELECT 'none', 'file not found', 0, NULL""")
def q_file_source(spark, sf_dir):
    """Documents as files of equal names in several folders, one that is no text and one that isn't there, through the file
    source."""
    path = scratch(spark)
    d = read(spark, sf_dir, "documents").select("text", (F.col("doc_id") % 8).cast("string").alias("folder"))
    bad = d.where("folder = '0'").select(F.concat(F.lit("\x00"), "text").alias("text"), F.lit("bad").alias("folder"))
    d.unionByName(bad).repartition(4, "folder").write.partitionBy("folder").text(path)
    names = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path").orderBy("path").collect()]
    rows = filesource.scan_files(spark, [*names, f"{path}/folder=none/{names[0].rsplit('/', 1)[-1]}"])
    return rows.groupBy(F.regexp_extract("path", "folder=([^/]*)/", 1).alias("folder"), "error").agg(F.count("text").alias("fragments"), F.sum(F.char_length("text")).cast("long").alias("chars"))


@query("""
WITH d AS (SELECT doc_id % 16 AS folder, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS page_no, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\s\\x1c-\\x1f\\x85\\xa0]'))) AS fragments FROM documents)
SELECT folder, page_no::INT AS page_no, fragments FROM d WHERE page_no BETWEEN 3 AND 5 AND fragments > 0""")
def q_file_pages(spark, sf_dir):
    """All documents as pages of sixteen files, of which pages 3 to 5 are asked for: the condition reaches the source."""
    path = scratch(spark)
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\f")).alias("text"), (F.col("doc_id") % 16).alias("folder"))
    d.repartition(4, "folder").sortWithinPartitions("folder", "doc_id").select("text", "folder").write.partitionBy("folder").text(path)
    names = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path").orderBy("path").collect()]
    rows = filesource.scan_files(spark, names, files_per_task=2).where("page_no >= 3 and page_no <= 5")
    return rows.groupBy(F.regexp_extract("path", "folder=([^/]*)/", 1).cast("long").alias("folder"), "page_no").agg(F.count("text").alias("fragments"))


# Listings


def _chains(spark, sf_dir):
    """Pages of crawls that know the next one alone, in random order; some lead back to the first, some to another site."""
    url = lambda page: F.concat(F.lit("/api/"), F.col("run_id").cast("string"), F.lit("/"), F.md5(page.cast("string")))
    p = _pages(spark, sf_dir)
    last = p.groupBy("run_id").agg(F.max("page").alias("last"))
    end = F.when(F.col("run_id") % 5 == 1, F.concat(F.lit("https://x.org"), url(F.lit(0)))).when(F.col("run_id") % 5 == 2, "https://y.org/api")
    made = p.join(last, "run_id").select("run_id", F.concat(F.lit("https://x.org"), url(F.col("page"))).alias("url"), F.when(F.col("page") < F.col("last"), url(F.col("page") + 1)).otherwise(end).alias("next"), "body")
    starts = last.select("run_id", F.concat(F.lit("https://x.org"), url(F.lit(0))).alias("url"))
    return listings.chain(made.orderBy(F.md5("url")), starts, "https://x.org")


@query(_CRAWL + "SELECT run_id, o_orderkey FROM k")
def q_chain_crawl(spark, sf_dir):
    pages, _ = _chains(spark, sf_dir)
    return feeds.crawl(feeds.parse_pages(pages), pages).select("run_id", F.col("id").cast("long").alias("o_orderkey"))


@query(_CRAWL + "SELECT run_id, max(page) + 1 AS pages, run_id % 5 = 2 AS truncated FROM o GROUP BY 1")
def q_chain_summary(spark, sf_dir):
    return _chains(spark, sf_dir)[1]


@query("""
WITH p AS (SELECT page_id, len(string_split(html, '<p>')) - 1 AS n, page_id % 4 AS m FROM pages)
SELECT page_id, array_to_string(list_concat([('9000' || j) FOR j IN range(1, m + 1)], CASE WHEN m > 0 AND m >= 0.8 * (n + m) THEN []::VARCHAR[] ELSE [(i::VARCHAR) FOR i IN range(1, n + 1)] END), ',') AS ids FROM p WHERE n + m > 0""")
def q_container_links(spark, sf_dir):
    """Whole pages whose paragraphs link to posts, as does their navigation, and some of their advertisements: links of the
    deepest container."""
    p = read(spark, sf_dir, "pages")
    linked = F.array_join(F.transform(F.split("html", "<p>", -1), lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit('<p><a class="x" href="/posts/a-name-'), i.cast("string"), F.lit('">link</a>'), part))), "")
    ads = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int")), lambda j: F.when(j > 0, F.concat(F.lit("<a href='/posts/9000"), j.cast("string"), F.lit("?x=1'>ad</a>"))).otherwise("")), "")
    html = F.replace(F.replace(linked, F.lit('<div class="ad">'), F.concat(F.lit('<div class="ad">'), ads)), F.lit("<nav><ul>"), F.lit('<nav><ul><li><a href="/posts/77">n</a></li>'))
    found = listings.container_links(p.select("page_id", html.alias("html")), "page_id", "html", lambda u: feeds.numeric_id(u, "posts"))
    return found.select("page_id", F.array_join("ids", ",").alias("ids"))


@query("""
WITH c AS (SELECT o_custkey AS run, o_orderkey % 3 AS ord, list(o_orderkey ORDER BY o_orderkey) AS ids, bool_or(o_orderkey % 11 = 0) AS truncated FROM orders GROUP BY 1, 2),
e AS (SELECT o_custkey AS run, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 10 END AS expected FROM orders GROUP BY 1),
f AS (SELECT c.*, e.expected, NOT truncated AND (coalesce(expected, 0) = 0 OR len(ids) >= floor(expected * 0.9)) AS complete FROM c JOIN e USING (run)
  WHERE NOT (coalesce(expected, 0) > 0 AND len(ids) > expected + greatest(5, 0.1 * expected)) AND (run % 2 = 0 OR list_contains(ids, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = run))))
SELECT run, arg_max(ord, k)::INT AS ord, arg_max(len(ids), k)::INT AS found, max(complete) AS complete FROM (SELECT *, complete::INT * 1000000 + CASE WHEN complete THEN 0 ELSE len(ids) END * 1000 - ord AS k FROM f) GROUP BY 1""")
def q_chosen_listing(spark, sf_dir):
    """Orders of a customer in three listings, of which the first complete or the longest plausible one counts."""
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "run")
    c = o.groupBy("run", (F.col("o_orderkey") % 3).cast("int").alias("ord")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"), F.bool_or(F.col("o_orderkey") % 11 == 0).alias("truncated")).withColumn("source", F.lit("api"))
    shown = o.where("run % 2 = 1").groupBy("run").agg(F.array(F.min("o_orderkey")).alias("ids"))
    expected = o.where("run % 4 > 0").select("run", (F.col("run") % 10).alias("expected")).distinct()
    return listings.chosen_listing(c, "run", shown, expected).select("run", "ord", "found", "complete")


# Resources


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END END AS posts, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey::VARCHAR END AS first,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CASE o_orderkey % 6 WHEN 0 THEN 'https://x.org/a?page=2' WHEN 1 THEN 'https://x.org/b' WHEN 2 THEN 'https://x.org/api/posts?k=v%20w&page%5Bcursor%5D=c+' || o_orderkey || '%26' WHEN 4 THEN 'https://x.org/api/posts?n=1' END END AS next,
  o_orderkey % 7 <> 0 AND o_orderkey % 6 = 3 AS rejected, CASE WHEN o_orderkey % 7 = 0 THEN 'Listing response has no data array.' END AS error FROM orders""")
def q_listing_pages(spark, sf_dir):
    """Orders as pages of a listing: links as strings and objects, cursors, queries, links that lead away or nowhere, and pages of
    another shape; ids that are numbers, and resources that are no posts or have none."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    n = k.cast("string")
    go = F.when(k % 6 == 0, '{"links":{"next":"/a?page=2"}').when(k % 6 == 1, '{"links":{"next":{"href":"https://x.org/b"}}').when(k % 6 == 2, F.concat(F.lit('{"links":{},"meta":{"pagination":{"cursors":{"next":"c '), n, F.lit('&"}}}')))
    go = go.when(k % 6 == 3, '{"links":{"next":"https://x.org.y.com/a"}').when(k % 6 == 4, '{"meta":{"next_cursor":"?n=1"}').otherwise('{"links":{"next":"https://x.org/api/posts?k=v%20w&page%5Bcursor%5D=old"},"meta":5')
    two = F.when(k % 5 != 0, F.concat(F.lit(',{"type":"post","id":"s'), n, F.lit('","attributes":{"title":7}}'))).otherwise(',{"type":"post","id":null}')
    body = F.concat(go, F.lit(',"data":[{"type":"tier","id":"1"},{"id":'), n, F.lit("}"), two, F.lit(",3]}"))
    pages = o.select(k, F.lit("https://x.org/api/posts?k=v%20w&page%5Bcursor%5D=old").alias("url"), F.when(k % 14 == 0, '{"data":{}}').when(k % 7 == 0, "<html>").otherwise(body).alias("body"))
    made = resources.listing_pages(pages, "https://x.org")
    return made.select("o_orderkey", F.size("posts").alias("posts"), F.get("posts", F.lit(0))["id"].alias("first"), "next", "rejected", "error")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS post_count,
  CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_partkey || ',b' WHEN p_partkey % 3 = 1 THEN 'b,r' ELSE 'b,c' END AS ids,
  CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 3 = 2 THEN 'last,C' ELSE 'last' END AS titles, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CASE p_partkey % 4 WHEN 0 THEN 'large' WHEN 1 THEN 'default' WHEN 2 THEN 'plain' ELSE 'image' END END AS cover,
  CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'vanity' END END AS creator FROM part""")
def q_collection_info(spark, sf_dir):
    """Parts as collections: ids from three places, covers from four, and creators from two."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    n = k.cast("string")
    ids = F.when(k % 3 == 0, F.concat(F.lit('"post_ids":['), n, F.lit(',"b",null,"b"],'))).otherwise('"post_ids":[],')
    rel = F.when(k % 3 == 1, '"relationships":{"posts":{"data":[{"id":"b"},{"id":"r"},5,{"id":"b"}]}},').otherwise("")
    thumb = F.when(k % 4 == 0, '"thumbnail":{"default":"d","large":"large"}').when(k % 4 == 1, '"thumbnail":{"large":"","url":"u","default":"default"}').when(k % 4 == 2, '"thumbnail":"plain","image_url":"i"').otherwise('"thumbnail":{},"image_url":"image"')
    campaign = F.when(k % 2 == 0, F.concat(F.lit('{"type":"campaign","attributes":{"vanity":"vanity","name":"'), F.col("p_brand"), F.lit('"}}'))).otherwise('{"type":"campaign","attributes":{"vanity":"vanity","name":""}}')
    body = F.concat(F.lit('{"data":{'), rel, F.lit('"attributes":{'), ids, thumb, F.lit(',"num_posts":'), F.col("p_size").cast("string"), F.lit(',"title":"'), F.col("p_name"), F.lit('"}},"included":['), campaign, F.lit(',{"type":"post","id":"b","attributes":{"title":"first"}},{"type":"post","id":"b","attributes":{"title":"last"}},{"type":"post","id":"c","attributes":{"title":"C"}}]}'))
    i = resources.collection_info(p.select("p_partkey", F.when(k % 9 == 0, '{"data":[]}').otherwise(body).alias("body")), "body")
    return i.select("p_partkey", "title", "post_count", F.array_join("ids", ",").alias("ids"), F.array_join(F.transform("posts", lambda x: x["title"]), ",").alias("titles"), "cover", "creator")


@query("""
WITH d AS (SELECT doc_id, doc_id % 8 AS k, md5(text) AS h FROM documents)
SELECT doc_id, k IN (0, 1, 5) AS ok, CASE k WHEN 2 THEN 'locked' WHEN 3 THEN 'missing' WHEN 4 THEN 'locked' WHEN 6 THEN 'empty' WHEN 7 THEN 'transient' END AS kind,
  CASE WHEN k IN (0, 1, 4) THEN 'own' WHEN k IN (5, 6) THEN 'page' ELSE 'Post ' || doc_id END AS title, CASE WHEN k IN (0, 5) THEN h END AS html, CASE WHEN k = 1 THEN h END AS document FROM d""")
def q_post_results(spark, sf_dir):
    """Documents as posts: their whole texts as the API's HTML, as rich-text documents, or found in the post's page; locked,
    missing, previews, and pages that have nothing or fail."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id") % 8
    attributes = F.when(k == 0, F.struct(F.lit("own").alias("title"), F.col("text").alias("content"), F.lit(None).cast("string").alias("content_json_string"), F.lit(True).alias("current_user_can_view")))
    rich = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text")))
    attributes = attributes.when(k == 1, F.struct(F.lit("own").alias("title"), F.lit(" ").alias("content"), rich.alias("content_json_string"), F.lit(None).cast("boolean").alias("current_user_can_view")))
    attributes = attributes.when(k == 4, F.struct(F.lit("own").alias("title"), F.col("text").alias("content"), F.lit(None).cast("string").alias("content_json_string"), F.lit(False).alias("current_user_can_view")))
    attributes = attributes.otherwise(F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content"), F.lit('{"type":"doc","content":[]}').alias("content_json_string"), F.lit(True).alias("current_user_can_view")))
    body = F.to_json(F.struct(F.struct(F.col("doc_id").alias("id"), attributes.alias("attributes")).alias("data")))
    page = F.concat(F.lit('<div data-x="post"><p class="x">no</p><div class="a Body-1">'), F.col("text"), F.lit("</div></div>"))
    found = sheets.with_element(d.select("doc_id", "text", F.when(k == 5, page).when(k == 6, '<div class="Body-1"> <br> </div>').alias("page")), "page", r"Body-1", "page_body")
    answers = d.join(found.select("doc_id", "page_body"), "doc_id").select(
        F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.when(k == 2, False).alias("can_view"), F.when(k == 3, "missing").when(k == 6, "page").otherwise("ok").alias("kind"), body.alias("body"),
        F.when(k == 7, "transient").otherwise("ok").alias("page_kind"), "page_body", F.when(k.isin(5, 6), "page").alias("page_title"), "text",
    )
    made = resources.post_results(answers.drop("text"))
    mark = lambda c: F.md5(c)
    return made.select(F.col("id").alias("doc_id"), "ok", "kind", "title", mark(F.col("html")).alias("html"), mark(F.get_json_object("document", "$.text")).alias("document"))


# Chapters


@query("""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE doc_id % 5 NOT IN (1, 2)),
t AS (SELECT doc_id, k, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS t FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Part ' || doc_id ELSE 'Book' END AS title, md5(string_agg(t, chr(10) ORDER BY k)) AS h, count(*) AS blocks FROM t WHERE t <> '' GROUP BY doc_id""")
def q_post_chapters(spark, sf_dir):
    """Documents as posts: HTML, rich-text documents, scene breaks alone, and nothing."""
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id") % 5
    lines = F.split("text", "\n", -1)
    html = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), text.escape_xml(x), F.lit("</p>"))), "\n")
    document = F.to_json(F.struct(F.lit("doc").alias("type"), F.transform(lines, lambda x: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), x.alias("text"))).alias("content"))).alias("content")))
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Book - Part "), F.col("doc_id").cast("string"))).otherwise("Book")
    posts = d.select("doc_id", title.alias("title"), F.when(k == 0, " \n").when(k == 1, "<p>* * *</p><hr>").when(k == 2, None).otherwise(html).alias("html"), F.when(k == 0, document).when(k == 1, document).alias("document"))
    made = chapters.post_chapters(posts, "doc_id", "Book")
    return made.select("doc_id", "title", F.md5(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")).alias("h"), F.size("blocks").cast("long").alias("blocks"))


@query("""
SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part WHERE p_partkey % 4 <> 0 QUALIFY place <= 500""")
def q_profiles(spark, sf_dir):
    """Parts as saved rule sets, the last changed 500."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 != 0, "{}").alias("config"), F.col("p_size").alias("updated_at"))
    return library.profiles(p).limit(500).select("id", F.expr("row_number() over (order by updated_at desc, id)").cast("long").alias("place"))


# A library in versions, and books


@query("""
WITH s AS (SELECT conv_id AS id, count(*) AS n, (2 * sum(length(role) + 16 + length(text) + 8))::BIGINT AS chapters_size FROM conversations GROUP BY 1),
c AS (SELECT count(*) * 2 // 3 AS cap, count(*) FILTER (id % 2 = 1) AS odd FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY id % 2 ORDER BY id DESC) AS newest FROM s)
SELECT id, n AS size, chapters_size, n AS stored FROM r, c WHERE newest <= CASE WHEN id % 2 = 1 THEN cap ELSE cap - odd END""")
def q_library_versions(spark, sf_dir):
    """Conversations put into a library in two versions, even ones first, of which two thirds of all may stay: the oldest even ones
    make room for the odd ones."""
    c = read(spark, sf_dir, "conversations")
    chapter = F.struct("turn", F.col("role").alias("title"), F.array(F.struct("text")).alias("blocks"))
    made = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(chapter)).alias("c"), F.count("*").alias("size"))
    records = made.select("id", (F.col("id") * 10).alias("created_at"), "size", F.transform("c", lambda x: F.struct(x["title"], x["blocks"])).alias("chapters"))
    cap = records.count() * 2 // 3
    lib = versions.Library(spark, scratch(spark))
    lib.put(records.where("id % 2 = 0"), cap)
    lib.put(records.where("id % 2 = 1"), cap)
    outputs, texts = lib.read()
    return outputs.join(texts.select("id", F.size("chapters").cast("long").alias("stored")), "id", "left").select("id", "size", "chapters_size", "stored")


@query("""
WITH l AS (SELECT source, doc_id, k, string_split(t, ' ') AS ws FROM (SELECT source, doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^a-z]+', ' ', 'g'), ' ') AS t FROM documents) WHERE t <> ''),
w AS (SELECT source, doc_id, k, i, ws[i] AS w, k % 3 = 0 AND length(ws[i]) >= 8 AS brk FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM l)),
v AS (SELECT source, w FROM w WHERE NOT brk UNION SELECT source, left(w, 4) FROM w WHERE brk UNION SELECT source, substr(w, 5) FROM w WHERE brk),
b AS (SELECT DISTINCT source, w FROM w WHERE brk),
a AS (SELECT source, w, w AS base FROM b
  UNION ALL SELECT source, w, left(w, length(w) - length(x)) FROM b, (SELECT unnest(['ness', 'tion', 'ing', 'ize', 'ly', 'ed', 'es', 's']) AS x) WHERE length(w) > length(x) + 2 AND ends_with(w, x)
  UNION ALL SELECT source, w, left(w, length(w) - length(x)) || 'e' FROM b, (SELECT unnest(['ing', 'ed']) AS x) WHERE length(w) > length(x) + 2 AND ends_with(w, x)
  UNION ALL SELECT source, w, substr(w, length(x) + 1) FROM b, (SELECT unnest(['dis', 're', 'un', 'in']) AS x) WHERE length(w) > length(x) + 2 AND starts_with(w, x)),
j AS (SELECT DISTINCT a.source, a.w FROM a JOIN v ON v.source = a.source AND v.w = a.base),
o AS (SELECT doc_id, k, string_agg(CASE WHEN brk AND j.w IS NULL THEN left(w.w, 4) || '-' || substr(w.w, 5) ELSE w.w END, ' ' ORDER BY i) AS t FROM w LEFT JOIN j ON brk AND j.source = w.source AND j.w = w.w GROUP BY 1, 2)
SELECT doc_id, count(*) AS blocks, md5(string_agg(t, chr(10) ORDER BY k)) AS h FROM o GROUP BY doc_id""")
def q_dehyphenate_books(spark, sf_dir):
    """Sources as books and documents as their chapters, in letters; in each third line all long words are broken: joined again if
    the book has them or a base of them elsewhere, else with their hyphen."""
    t = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    lines = read(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "text")).select("source", "doc_id", "k", t.alias("t")).where("t <> ''")
    broken = F.when(F.col("k") % 3 == 0, F.regexp_replace("t", r"\b([a-z]{4})([a-z]{4,})\b", "$1- $2")).otherwise(F.col("t"))
    block = F.struct("k", F.struct(F.lit("p").alias("type"), broken.alias("text")).alias("b"))
    books = lines.groupBy(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_no")).agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("blocks"))
    made = vocabulary.dehyphenate_chapters(books)
    return made.select(F.col("chapter_no").alias("doc_id"), F.size("blocks").cast("long").alias("blocks"), F.md5(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")).alias("h"))


# Streams


def _streamed(spark, rows):
    """rows as a stream of the files that they are written to."""
    path = scratch(spark)
    rows.repartition(8, "user_id").write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query(_POLICY)
def q_stream_requests(spark, sf_dir):
    """What q_slowdown says, from a stream."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = _answers(spark, sf_dir).join(e, "event_id")
    with requests.state_store(spark):
        out = policy.once(requests.requests(_streamed(spark, rows), 10**13), spark, "append")
    return out.where("outcome <> 'abandoned'").select("event_id", F.round("slow", 6).alias("slow"), "cooldown", "hits", "waited", "outcome")


@query("""
WITH e AS (SELECT event_id, (floor(epoch(ts))::BIGINT * 1000) AS ms, max(CASE WHEN event_type <> 'error' THEN (floor(epoch(ts))::BIGINT * 1000) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS saved FROM events)
SELECT event_id, coalesce(ms - saved <= 86400000, false) AS hit, CASE WHEN ms - saved <= 86400000 THEN ms - saved END AS age_ms FROM e""")
def q_stream_cache(spark, sf_dir):
    """Events that look for a success of their user's last day."""
    e = read(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    rows = e.select("user_id", "event_id", ts.alias("ts"), (F.unix_seconds(ts) * 1000).alias("at"), (F.col("event_type") != "error").alias("ok"))
    with requests.state_store(spark):
        out = policy.once(requests.cache_hits(_streamed(spark, rows), 86_400_000), spark, "append")
    return out.select("event_id", "hit", "age_ms")


# Dictionaries


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM (SELECT doc_id, translate(text, 'İK', '  ') AS text FROM documents))
SELECT doc_id, left(md5(w), 1) AS class, count(*) AS n, sum(length(w))::BIGINT AS chars FROM w WHERE length(w) >= 4 AND md5(w) < '8' GROUP BY 1, 2""")
def q_phrases(spark, sf_dir):
    """Half of all words of four letters or more as a dictionary, found in all texts by one automaton."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.translate("text", "İK", "  ").alias("text"))
    words = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).where("length(w) >= 4 and md5(w) < '8'").distinct()
    rows = words.select(F.when(F.md5("w") < "4", F.upper("w")).otherwise(F.col("w")).alias("phrase"), F.lit(0).alias("ord"), F.left(F.md5("w"), F.lit(1)).alias("class"))
    found = automaton.phrase_matches(d, "doc_id", "text", rows)
    return found.groupBy("doc_id", "class").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("chars"))
