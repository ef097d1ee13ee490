"""Listings that say less of themselves: chains of pages that only know the next one, links of a page without tags, and the
choice among several listings of one collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.runtime import written
from folio.sources.feeds import same_origin, too_many

# Parts of a site that surround its content, tags of containers (their end tags must be there), and tags whose
# contents are no markup
CHROME = ["header", "nav", "aside", "footer"]
CONTAINERS = [*CHROME, "html", "body", "div", "section", "article", "main", "ul", "ol", "table", "form", "figure", "blockquote", "dl", "details", "center"]
RAW = ["script", "style", "template", "textarea", "title"]
MOST_STEPS = 1 << 20


def chain(pages: DataFrame, starts: DataFrame, origin: str) -> tuple[DataFrame, DataFrame]:
    """pages(run_id, url, next, ...) and starts(run_id, url) -> (the pages that a crawl from the start reaches, with `page`,
    their number from 0, and a row (run_id, pages, truncated) for each run).

    A list ranking by pointer doubling: after round k a page knows the one that is 2^k steps on, and all pages up to 2^k
    steps from the start are ranked, so a chain of n pages takes about log2(n) joins and no loop over pages. next may be a
    path; one that leads to another origin ends the chain, which is truncated then; a cycle ends before the first page that
    has been met; a url that no page has ends the chain. Of several pages of one url in a run any one counts."""
    own = written(pages.withColumn("_to", same_origin(F.col("next"), origin)).dropDuplicates(["run_id", "url"]))
    jump = own.where("_to is not null").select("run_id", "url", F.col("_to").alias("to"))
    ranked = written(starts.select("run_id", "url").distinct().withColumn("page", F.lit(0).cast("long")))
    n, step = ranked.count(), 1
    while step <= MOST_STEPS:
        on = ranked.join(jump, ["run_id", "url"]).select("run_id", F.col("to").alias("url"), (F.col("page") + step).alias("page"))
        grown = written(ranked.unionByName(on).groupBy("run_id", "url").agg(F.min("page").alias("page")))
        more = grown.count()
        if more == n:
            break
        ranked, n, step = grown, more, step * 2
        far = jump.select("run_id", F.col("url").alias("to"), F.col("to").alias("_far"))
        jump = written(jump.join(far, ["run_id", "to"]).select("run_id", "url", F.col("_far").alias("to")))
    reached = own.join(ranked, ["run_id", "url"])
    # From the first page on that is met again, pages come a second time; ranks beside it are the first
    last = reached.groupBy("run_id").agg(F.count("*").alias("pages"), F.max(F.col("next").isNotNull() & F.col("_to").isNull()).alias("truncated"))
    return reached.drop("_to"), last


def tags(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """id_, pos, name (lower case), closes, rest (what stands in the tag) of the start and end tags of each page, in order. Comments and what
    stands in RAW elements are no tags."""
    raw = "|".join(RAW)
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", ""), rf"(?is)(<({raw})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>).*?</\2[ \t\r\n]*>", "")
    found = F.regexp_extract_all(bare, F.lit(r"""(?s)</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0))
    rows = pages.select(id_, F.posexplode(found).alias("pos", "_t"))
    name = F.lower(F.regexp_extract("_t", r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    return rows.select(id_, "pos", name.alias("name"), F.col("_t").startswith("</").alias("closes"), F.col("_t").alias("rest"))


def container_links(pages: DataFrame, id_: str, html: str, found: Callable[[Column], Column], share: float = 0.8) -> DataFrame:
    """id_, ids: of each page with links, what they lead to, each once in the order of first places. found: the id of an
    href's value, null for other links.

    Links within CHROME don't count. The pool is the deepest container around the first link that holds `share` of all
    links; without any, all links. Containers are CONTAINERS elements: a running sum of starts less ends gives their depth,
    a container's rows are those up to the next end of its depth, and each link is joined with the containers around it,
    whose number is its depth."""
    w = Window.partitionBy(id_).orderBy("pos")
    t = tags(pages, id_, html)
    boxes = t.where(F.col("name").isin(CONTAINERS))
    href = F.regexp_extract("rest", r"""(?is)[ \t\r\n"']href[ \t\r\n]*=[ \t\r\n]*(?:"([^"]*)"|'([^']*)'|([^ \t\r\n"'>]+))""", 0)
    value = F.regexp_replace(href, r"""(?is)^[ \t\r\n"']href[ \t\r\n]*=[ \t\r\n]*["']?|["']\z""", "")
    links = t.where((F.col("name") == "a") & ~F.col("closes")).withColumn("_id", found(value)).where("_id is not null")
    links = links.join(pages.select(id_), id_, "left_semi")
    both = boxes.select(id_, "pos", "name", F.when(F.col("closes"), -1).otherwise(1).alias("step"), F.lit(None).cast("string").alias("_id"))
    both = both.unionByName(links.select(id_, "pos", F.lit("a").alias("name"), F.lit(0).alias("step"), "_id"))
    deep = both.withColumn("depth", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    # A link at depth d is in the last container that began at each depth from 1 to d
    opens = deep.where("step = 1").select(id_, F.col("depth").alias("level"), "pos", "name", F.lit(True).alias("box"), F.lit(None).cast("string").alias("_id"))
    around = deep.where("step = 0 and depth > 0").select(id_, F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("level"), "pos", "name", F.lit(False).alias("box"), "_id")
    at = Window.partitionBy(id_, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = opens.unionByName(around).withColumn("_o", F.last(F.when(F.col("box"), F.struct("pos", "name")), True).over(at)).where("not box")
    # A row for each link and container around it
    within = held.select(id_, F.col("pos").alias("link"), "_id", "level", F.col("_o.pos").alias("container"), F.col("_o.name").isin(CHROME).alias("chrome"))
    surrounded = within.where("chrome").select(id_, "link").distinct()
    good = links.select(id_, F.col("pos").alias("link"), "_id").join(surrounded, [id_, "link"], "left_anti")
    total = good.groupBy(id_).agg(F.count("*").alias("total"), F.min("link").alias("first"))
    inside = within.join(good.select(id_, "link"), [id_, "link"], "left_semi")
    counts = inside.groupBy(id_, "level", "container").agg(F.count("*").alias("n"), F.min("link").alias("first"))
    # Around the first link: the containers whose first good link it is
    best = counts.join(total, [id_, "first"]).where(F.col("n") >= F.lit(share) * F.col("total")).groupBy(id_).agg(F.max_by("container", "level").alias("container"))
    chosen = inside.join(best, [id_, "container"], "left_semi").select(id_, "link", "_id")
    rest = good.join(best.select(id_), id_, "left_anti")
    firsts = chosen.unionByName(rest.select(id_, "link", "_id")).groupBy(id_, "_id").agg(F.min("link").alias("link"))
    return firsts.groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(F.struct("link", "_id"))), lambda x: x["_id"]).alias("ids"))


def page_links(pages: DataFrame, id_: str, html: str, tagged: Column, found: Callable[[Column], Column]) -> DataFrame:
    """id_, ids, source: the tagged links (array, in order) where there are any, else those of the deepest container."""
    own = pages.select(id_, tagged.alias("ids"))
    have = own.where(F.size("ids") > 0).withColumn("source", F.lit("page"))
    others = pages.join(have.select(id_), id_, "left_anti")
    return have.unionByName(container_links(others, id_, html, found).withColumn("source", F.lit("page-untagged")))


def chosen_listing(candidates: DataFrame, by: str, shown: DataFrame, expected: DataFrame) -> DataFrame:
    """Of each run's candidates(by, ord, source, ids, truncated), the listing that counts: by, ord, source, ids, found,
    expected, complete.

    A candidate is plausible if it has ids, shares one with those shown(by, ids), if any are, and isn't far over what is
    expected(by, expected), if a number is. It is complete if it isn't truncated and has nine tenths of what is expected. The
    first complete one in the order of ord counts, else the longest, the first of equal ones."""
    c = candidates.join(shown.select(by, F.col("ids").alias("_shown")), by, "left").join(expected.select(by, "expected"), by, "left")
    n, e = F.size("ids"), F.col("expected")
    seen = F.coalesce(F.col("_shown"), F.array().cast(candidates.schema["ids"].dataType))
    fits = (n > 0) & ((F.size(seen) == 0) | F.arrays_overlap("ids", seen)) & ~((F.coalesce(e, F.lit(0)) > 0) & too_many(n, e))
    complete = ~F.col("truncated") & ((F.coalesce(e, F.lit(0)) == 0) | (n >= F.floor(e * 0.9)))
    rows = c.where(fits).select(by, "ord", "source", "ids", n.alias("found"), "expected", F.coalesce(complete, F.lit(True)).alias("complete"))
    rank = F.struct(F.col("complete"), F.when(F.col("complete"), 0).otherwise(F.col("found")), -F.col("ord"))
    return rows.groupBy(by).agg(F.max_by(F.struct("ord", "source", "ids", "found", "expected", "complete"), rank).alias("b")).select(by, "b.*")
