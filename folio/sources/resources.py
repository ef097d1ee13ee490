"""JSON:API documents read property by property, as variants: what has another type than it should counts as missing, one
document at a time, and a document of another shape is that document's error."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import js
from folio.operators.markup import rich_text_to_blocks
from folio.sources.feeds import same_origin

REF = "struct<id:string,title:string,published_at:string,url:string,can_view:boolean>"
CURSOR = "page%5Bcursor%5D"


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def string_at(v: Column, path: str) -> Column:
    """A string that isn't empty, or null."""
    x = _at(v, path)
    return F.when(_kind(x) == "STRING", F.nullif(x.cast("string"), F.lit("")))


def id_of(x: Column) -> Column:
    """A string that isn't empty, or a number as one, or null."""
    kind = _kind(x)
    return F.when(kind == "STRING", F.nullif(x.cast("string"), F.lit(""))).when(kind.rlike(r"^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), x.cast("string"))


def boolean_at(v: Column, path: str) -> Column:
    x = _at(v, path)
    return F.when(_kind(x) == "BOOLEAN", x.cast("boolean"))


def list_at(v: Column, path: str) -> Column:
    """array<variant>; empty if there is no list."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def is_object(x: Column) -> Column:
    return _kind(x).startswith("OBJECT")


def resource(x: Column) -> Column:
    """REF of a post's resource; null without an id."""
    a = "$.attributes."
    ref = F.struct(
        id_of(_at(x, "$.id")).alias("id"), string_at(x, a + "title").alias("title"), string_at(x, a + "published_at").alias("published_at"),
        string_at(x, a + "url").alias("url"), boolean_at(x, a + "current_user_can_view").alias("can_view"),
    )
    return F.when(is_object(x) & ref["id"].isNotNull(), ref)


def posts_of(v: Column, path: str, untyped: bool) -> Column:
    """array<REF> of the posts in a list of resources; untyped: those without a type are posts, too."""
    typed = lambda x: (string_at(x, "$.type") == "post") | ((_kind(_at(x, "$.type")) == "") if untyped else F.lit(False))
    refs = F.transform(F.filter(list_at(v, path), lambda x: F.coalesce(typed(x), F.lit(False))), resource)
    return F.filter(refs, lambda r: r.isNotNull())


def listing_pages(pages: DataFrame, origin: str) -> DataFrame:
    """pages(run_id, url, body, ...) with posts (array<REF>), next, rejected and error.

    Where a listing goes on: a link counts, from links.next or its href; else a cursor, from links.next or the metadata, where
    it may also be a link. A link may be a path, or a query of the same page; one that leads to another origin is rejected; one to
    the page itself is none. Each step is a column of its own, so that no expression is made twice."""
    v, c = F.col("_v"), F.col
    seen = pages.withColumn("_v", F.try_parse_json("body"))
    seen = seen.withColumn("_ok", F.coalesce(is_object(v) & _kind(_at(v, "$.data")).startswith("ARRAY"), F.lit(False))).withColumn("_v", F.when(c("_ok"), v)).withColumn("_given", _at(v, "$.links.next"))
    seen = seen.withColumns({
        "_link": F.coalesce(F.when(_kind(c("_given")) == "STRING", F.nullif(c("_given").cast("string"), F.lit(""))), string_at(c("_given"), "$.href")), "_own": string_at(c("_given"), "$.cursor"),
        "_meta": F.coalesce(string_at(v, "$.meta.pagination.cursors.next"), string_at(v, "$.meta.pagination.next"), string_at(v, "$.meta.next_cursor")),
    })
    seen = seen.withColumn("_meta", F.when(c("_link").isNull() & c("_own").isNull(), c("_meta"))).withColumn("_looks", c("_meta").rlike(r"^(?:https?:)?/|^\?"))
    seen = seen.withColumns({"_to": F.coalesce("_link", F.when(c("_looks"), c("_meta"))), "_cursor": F.coalesce("_own", F.when(~c("_looks"), c("_meta"))), "_bare": F.regexp_replace("url", r"#.*\z", "")})
    others = F.filter(F.split(F.regexp_extract("_bare", r"\?(.*)\z", 1), "&", -1), lambda p: (p != "") & ~p.startswith(f"{CURSOR}=") & ~p.startswith("page[cursor]="))
    path = F.regexp_extract("_bare", r"^[^?]*", 0)
    whole = F.when(c("_to").startswith("?"), F.concat(path, "_to")).when(c("_to").startswith("//"), F.concat(F.lit("https:"), "_to")).otherwise(c("_to"))
    asked = F.concat(path, F.lit("?"), F.array_join(F.concat(others, F.array(F.concat(F.lit(f"{CURSOR}="), F.url_encode("_cursor")))), "&"))
    asked = F.when(c("_cursor").isNotNull(), asked)
    seen = seen.withColumn("_found", F.coalesce(whole, asked)).withColumn("_there", same_origin(c("_found"), origin))
    made = seen.withColumns({
        "posts": F.when(c("_ok"), posts_of(v, "$.data", True)), "next": F.when(c("_there") != c("url"), c("_there")),
        "rejected": c("_found").isNotNull() & c("_there").isNull(), "error": F.when(~c("_ok"), "Listing response has no data array."),
    })
    return made.drop("_v", "_ok", "_given", "_link", "_own", "_meta", "_looks", "_to", "_cursor", "_bare", "_found", "_there")


def collection_info(documents: DataFrame, body: str) -> DataFrame:
    """documents with title, description, post_count, ids, posts (array<REF>), cover, creator, sort_type and error of a
    collection's document in place of body; a document of another shape has an error alone.

    ids are those of its attribute, else of its relationship, else of the included posts, each once; posts are they with
    what is included of them, of several of one id the last; the cover is the best there is of its thumbnails."""
    v, a, c = F.col("_v"), "$.data.attributes.", F.col
    listed = lambda path, f: F.filter(F.transform(list_at(v, path), f), lambda i: i.isNotNull())
    some = lambda x: F.when(F.size(x) > 0, c(x))
    seen = documents.withColumn("_v", F.try_parse_json(body)).withColumn("_v", F.when(is_object(_at(v, "$.data")), v))
    seen = seen.withColumns({
        "_posts": posts_of(v, "$.included", False), "_own": listed(a + "post_ids", id_of), "_rel": listed("$.data.relationships.posts.data", lambda r: F.when(is_object(r), id_of(_at(r, "$.id")))),
        "_thumb": _at(v, a + "thumbnail"), "_n": _at(v, a + "num_posts"), "_campaign": F.get(F.filter(list_at(v, "$.included"), lambda r: F.coalesce(string_at(r, "$.type") == "campaign", F.lit(False))), F.lit(0)),
    })
    seen = seen.withColumn("_ids", F.array_distinct(F.coalesce(some("_own"), some("_rel"), F.transform("_posts", lambda p: p["id"]))))
    known = seen.withColumn("_known", F.map_from_entries(F.transform(F.array_distinct(F.transform("_posts", lambda p: p["id"])), lambda i: F.struct(i, F.element_at(F.filter("_posts", lambda p: p["id"] == i), -1)))))
    bare = lambda i: F.struct(i.alias("id"), *[F.lit(None).cast(k).alias(n) for n, k in (("title", "string"), ("published_at", "string"), ("url", "string"), ("can_view", "boolean"))])
    there = v.isNotNull()
    made = known.select(
        *[x for x in documents.columns if x != body], string_at(v, a + "title").alias("title"), string_at(v, a + "description").alias("description"),
        F.when(_kind(c("_n")).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), c("_n").cast("int")).alias("post_count"), F.when(there, c("_ids")).alias("ids"),
        F.when(there, F.transform("_ids", lambda i: F.coalesce(F.try_element_at("_known", i), bare(i)))).alias("posts"),
        F.coalesce(*[string_at(c("_thumb"), f"$.{k}") for k in ("large", "original", "default", "url")], F.when(_kind(c("_thumb")) == "STRING", c("_thumb").cast("string")), string_at(v, a + "image_url")).alias("cover"),
        F.coalesce(string_at(c("_campaign"), "$.attributes.name"), string_at(c("_campaign"), "$.attributes.vanity")).alias("creator"), string_at(v, a + "post_sort_type").alias("sort_type"),
        F.when(~there, "Collection response has no data object.").alias("error"),
    )
    return made


def post_document(body: Column) -> Column:
    """struct(id, title, html, document, published_at, can_view) of a post's document; null if it is none or has no id. Blank
    HTML is none, and only then the rich-text document counts."""
    v, a = F.try_parse_json(body), "$.data.attributes."
    raw = string_at(v, a + "content")
    html = F.when(js.trim(raw) != "", raw)
    ident = id_of(_at(v, "$.data.id"))
    made = F.struct(ident.alias("id"), string_at(v, a + "title").alias("title"), html.alias("html"), F.when(html.isNull(), string_at(v, a + "content_json_string")).alias("document"), string_at(v, a + "published_at").alias("published_at"), boolean_at(v, a + "current_user_can_view").alias("can_view"))
    return F.when(F.coalesce(is_object(_at(v, "$.data")), F.lit(False)) & ident.isNotNull(), made)


def has_text(document: Column) -> Column:
    """Whether a rich-text document has any text."""

    @F.pandas_udf("boolean")
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: d is not None and rich_text_to_blocks(d) is not None)

    return run(document)


def post_results(answers: DataFrame) -> DataFrame:
    """answers(id, title, can_view, kind, body, page_kind, page_body, page_title) -> id, ok, kind, title, html, document.

    kind and page_kind say what the API's answer and the post's page are (policy.classify); page_body is the body found in the
    page. What the API refuses for good counts as it is; a body comes from the API's HTML, its rich-text document, or the
    page, in this order. A preview isn't a body."""
    p = F.col("_p")
    api = F.when(F.col("kind") == "ok", post_document(F.col("body")))
    seen = answers.withColumn("_p", api).withColumn("_d", F.when(has_text(F.col("_p.document")), F.col("_p.document")))
    own = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Post "), F.col("id").cast("string")))
    hidden, preview = F.coalesce(~F.col("can_view"), F.lit(False)), F.coalesce(~p["can_view"], F.lit(False))
    refused = F.col("kind").isin("auth", "locked", "missing", "transient")
    paged = F.when((F.col("page_kind") == "ok") & (js.trim(F.regexp_replace("page_body", "<[^>]*>", "")) != ""), F.col("page_body"))
    from_page = p["html"].isNull() & F.col("_d").isNull()
    verdict = (
        F.when(hidden, "locked").when(refused, F.col("kind")).when(preview, "locked").when(~from_page, "ok")
        .when(paged.isNotNull(), "ok").when(F.col("page_kind") == "transient", "transient").otherwise("empty")
    )
    theirs = F.coalesce("_p.title", own)
    named = F.when(hidden | refused, own).when(preview | ~from_page, theirs).when(F.col("page_kind") == "ok", F.coalesce(F.nullif("page_title", F.lit("")), own)).otherwise(own)
    ok = F.col("_k") == "ok"
    return seen.withColumn("_k", verdict).select(
        "id", ok.alias("ok"), F.when(~ok, F.col("_k")).alias("kind"), named.alias("title"),
        F.when(ok, F.when(from_page, paged).otherwise(p["html"])).alias("html"), F.when(ok & p["html"].isNull(), F.col("_d")).alias("document"),
    )
