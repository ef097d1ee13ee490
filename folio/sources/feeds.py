"""Pages of JSON:API listings, read with the schema they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import js

PAGE = (
    "struct<data:array<struct<id:string,type:string,attributes:struct<title:string,published_at:string,url:string,current_user_can_view:boolean>>>,"
    "links:struct<next:string>,meta:struct<pagination:struct<cursors:struct<next:string>>>>"
)


def parse_pages(pages: DataFrame, kind: str = "post") -> DataFrame:
    """pages(run_id, page, body) -> run_id, page, pos, id, title, published_at, can_view, next; bad JSON and rows without id go."""
    body = pages.select("run_id", "page", F.from_json("body", PAGE, {"mode": "PERMISSIVE"}).alias("b"))
    rows = body.select("run_id", "page", F.coalesce("b.links.next", "b.meta.pagination.cursors.next").alias("next"), F.posexplode("b.data").alias("pos", "d"))
    return rows.where((F.col("d.type") == kind) & F.col("d.id").isNotNull()).select("run_id", "page", "pos", "d.id", "d.attributes.title", "d.attributes.published_at", F.col("d.attributes.current_user_can_view").alias("can_view"), "next")


def too_many(n: Column, expected: Column) -> Column:
    """Far over the number expected, if one is."""
    return F.coalesce(n > expected + F.greatest(F.lit(5.0), 0.1 * expected), F.lit(False))


def _fresh(rows: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with _new (first of its id), and (run_id, page, n) of all pages, n: how many new ids each has."""
    first = Window.partitionBy("run_id", "id").orderBy("page", "pos")
    marked = rows.withColumn("_new", F.row_number().over(first) == 1)
    counts = marked.groupBy("run_id", "page").agg(F.count_if("_new").alias("n"))
    return marked, pages.select("run_id", "page").distinct().join(counts, ["run_id", "page"], "left").select("run_id", "page", F.coalesce("n", F.lit(0)).alias("n"))


def crawl(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Each id once, from the pages(run_id, page, ...) up to the first that brings nothing new, be it without any row."""
    marked, fresh = _fresh(rows, pages)
    stop = fresh.where("n = 0").groupBy("run_id").agg(F.min("page").alias("_stop"))
    return marked.where("_new").join(stop, "run_id", "left").where(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).drop("_new", "_stop")


def crawl_summary(rows: DataFrame, pages: DataFrame, expected: DataFrame) -> DataFrame:
    """run_id, posts, pages, implausible, complete of each run of pages; expected(run_id, expected) may lack runs.

    Pages count up to the first that brings nothing new, itself included. Implausible: more pages than
    ceil(expected * 1.1 / 10) + 3 (60 if none is expected), or far more posts than expected. Complete: nine tenths of
    what is expected, rounded down, at least."""
    _, fresh = _fresh(rows, pages)
    stop = fresh.where("n = 0").groupBy("run_id").agg(F.min("page").alias("_stop"))
    read = fresh.join(stop, "run_id", "left").where(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
    runs = read.groupBy("run_id").agg(F.sum("n").alias("posts"), F.count("*").alias("pages")).join(expected, "run_id", "left")
    most = F.coalesce(F.when(F.col("expected") > 0, F.ceil(F.col("expected") * 1.1 / 10) + 3), F.lit(60))
    enough = F.coalesce((F.col("expected") == 0) | (F.col("posts") >= F.floor(F.col("expected") * 0.9)), F.lit(True))
    implausible = (F.col("pages") > most) | ((F.col("expected") > 0) & too_many(F.col("posts"), F.col("expected")))
    return runs.select("run_id", "posts", "pages", F.coalesce(implausible, F.lit(False)).alias("implausible"), enough.alias("complete"))


def order_of(sort_type: Column) -> Column:
    """What a listing's sort type says about its order; descending words count before ascending ones."""
    s = F.lower(F.coalesce(sort_type, F.lit("")))
    return F.when(s.rlike("desc|newest|latest|reverse"), "collection-desc").when(s.rlike("asc|oldest|earliest|custom|manual|collection_order|creator"), "collection-asc").otherwise("collection")


def api_url(origin: str, path: Column, parameters: list[tuple[str, Column]]) -> Column:
    """origin, path and the parameters that aren't null, in their order, encoded as forms are."""
    pairs = F.array(*[F.when(v.isNotNull(), F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(v.cast("string")))) for k, v in parameters])
    query = F.array_join(pairs, "&")
    return F.concat(F.lit(origin), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def posts_url(origin: str, collection: Column, sorted_: Column, page_size: Column) -> Column:
    """The listing of a collection's posts; page_size null or 0: the server's own."""
    size = F.when(page_size > 0, page_size)
    return api_url(origin, F.lit("/api/posts"), [("filter[collection_id]", collection), ("sort", F.when(sorted_, "collection_order")), ("page[count]", size), ("fields[post]", F.lit("title,published_at,url,current_user_can_view")), ("json-api-version", F.lit("1.0"))])


def post_url(origin: str, post: Column) -> Column:
    return api_url(origin, F.concat(F.lit("/api/posts/"), post), [("fields[post]", F.lit("title,content,content_json_string,published_at,current_user_can_view")), ("json-api-version", F.lit("1.0"))])


def same_origin(url: Column, origin: str) -> Column:
    """url resolved against origin if it is a path, else as it is; null if it leads elsewhere."""
    whole = F.when(url.startswith("/") & ~url.startswith("//"), F.concat(F.lit(origin), url)).otherwise(url)
    return F.when((whole == origin) | whole.startswith(origin + "/") | whole.startswith(origin + "?"), whole)


def published_ms(c: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(c))


def plausible(ids: Column, seen: Column, expected: Column) -> Column:
    """A listing that isn't empty, shares an id with those seen, and isn't far over the number expected."""
    room = F.greatest(F.lit(5.0), 0.1 * expected)
    return (F.size(ids) > 0) & ((F.size(seen) == 0) | F.arrays_overlap(ids, seen)) & (expected.isNull() | (F.size(ids) <= expected + room))


def count_matches(n: Column, expected: Column) -> Column:
    """Some ids, and as many as expected to 5 percent or 5, if a number is."""
    near = F.abs(n - expected) <= F.greatest(F.lit(5.0), 0.05 * expected)
    return (n > 0) & F.coalesce(near, F.lit(True))


def numeric_id(path: Column, folder: str) -> Column:
    """The number at the end of the name under a folder of a path: /folder/12, /folder/a-name-12."""
    return F.nullif(F.regexp_extract(path, rf"/{folder}/(?:[^/?#]*-)?([0-9]+)(?:[/?#]|\z)", 1), F.lit(""))


def linked_ids(html: Column, folder: str, tag: str, value: str) -> Column:
    """array<string>: distinct ids of links to a folder that carry tag=value, in the order of their first place."""
    from folio.operators.markup import decode_entities

    found = F.regexp_extract_all(html, F.lit(rf"""(?i)href[ \t\r\n]*=[ \t\r\n]*["']([^"']*/{folder}/[^"']*)["']"""), F.lit(1))
    ours = F.filter(F.transform(found, decode_entities), lambda u: F.regexp_extract(u, rf"[?&]{tag}=([0-9]+)", 1) == value)
    return F.array_distinct(F.filter(F.transform(ours, lambda u: numeric_id(u, folder)), lambda i: i.isNotNull()))


def listing_title(title: Column) -> Column:
    """struct(title, creator, count) of `Name | Collection from Creator | 178 posts | Site`."""
    parts = F.transform(F.split(title, r"\|", -1), lambda p: F.trim(p))
    flags = F.transform(parts, lambda p: p.rlike(r"(?i)^collection from[ \t]+"))
    at = F.array_position(flags, F.lit(True))
    rest = F.slice(parts, F.greatest(at, F.lit(1)) + 1, F.greatest(F.size(parts) - F.greatest(at, F.lit(1)), F.lit(0)))
    counted = F.filter(rest, lambda p: p.rlike(r"^[0-9][0-9.,\s]*\s+\p{L}+\z"))
    number = F.regexp_replace(F.regexp_extract(F.get(counted, F.lit(0)), r"^([0-9][0-9.,\s]*)\s", 1), "[^0-9]", "")
    creator = F.nullif(F.trim(F.regexp_replace(F.get(parts, at - 1), r"(?i)^collection from[ \t]+", "")), F.lit(""))
    return F.struct(F.when(at > 1, F.array_join(F.slice(parts, 1, at - 1), " | ")).alias("title"), F.when(at > 0, creator).alias("creator"), F.nullif(number, F.lit("")).cast("int").alias("count"))


def allowed_url(url: Column, hosts: list[str], suffixes: list[str] = []) -> Column:  # noqa: B006
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    ok = host.isin(hosts) if hosts else F.lit(False)
    for s in suffixes:
        ok = ok | host.endswith(s)
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & ok, F.lit(False))


def collection(body: Column) -> Column:
    """array<struct<id, title>> of a collection document: ids from its attribute, else its relationship, else what is
    included; each once, with the details of what is included."""
    kind = (
        "struct<data:struct<attributes:struct<post_ids:array<string>>,relationships:struct<posts:struct<data:array<struct<id:string>>>>>,"
        "included:array<struct<id:string,type:string,attributes:struct<title:string>>>>"
    )
    b = F.from_json(body, kind)
    posts = F.filter(F.coalesce(b["included"], F.array().cast("array<struct<id:string,type:string,attributes:struct<title:string>>>")), lambda p: (p["type"] == "post") & p["id"].isNotNull())
    some = lambda a: F.when(F.size(a) > 0, a)
    ids = F.coalesce(some(b["data"]["attributes"]["post_ids"]), some(F.transform(b["data"]["relationships"]["posts"]["data"], lambda p: p["id"])), F.transform(posts, lambda p: p["id"]))
    title = lambda i: F.get(F.filter(posts, lambda p: p["id"] == i), F.lit(0))["attributes"]["title"]
    return F.transform(F.array_distinct(F.filter(ids, lambda i: i.isNotNull())), lambda i: F.struct(i.alias("id"), title(i).alias("title")))


def post_content(html: Column, document: Column, page: Column) -> Column:
    """The first that has something: the API's HTML, its rich-text document, the page's body."""
    return F.coalesce(*[F.when(js.trim(c) != "", c) for c in (html, document, page)])
