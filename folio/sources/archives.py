"""Reading packages back into tables of entries, and rewriting whole packages of the older format.

A package is opened in the task that holds it, a row an entry (`opened`). What a rewritten book needs to know of itself, its
navigation points and where reading starts, is a row for each book that its entries are joined with (`repackaged`). A package
that can't be opened, or lacks what the new format needs, is a row of failures and never stops the others."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import escape_xml
from folio.runtime import written
from folio.sources import packages
from folio.sources.packages import CSS, FOLDER, NAV, concat, element

# Places in packages of the older format
COVER, TOC_END, CHAPTER_END = FOLDER + "front-cover.html", r"table-of-contents\.html\z", r"page-[0-9]+\.html\z"
MIMETYPE = "application/epub+zip"


def read_packages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """book_id (the whole path), package: the files of a folder or of a list of paths."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("book_id"), F.col("content").alias("package"))


def opened(books: DataFrame) -> DataFrame:
    """books(book_id, package) -> book_id, ord (from 0, as in the archive), path, content, stored, error. Folders are no
    entries. A package that can't be read is one row with an error, and no other column but book_id."""
    import pyarrow as pa

    kind = books.schema["book_id"].dataType.simpleString()

    def entries(package: bytes | None) -> tuple[list[tuple], str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(package or b"")) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                return [(n, i.filename, z.read(i), i.compress_type == zipfile.ZIP_STORED) for n, i in enumerate(infos)], None
        except Exception as e:  # noqa: BLE001  whatever is wrong with an archive is that book's error
            return [], str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # packages are large: one at a time
                rows, error = entries(batch.column("package")[at].as_py())
                columns = list(zip(*rows, strict=True)) if rows else [[None]] * 4
                n = len(columns[0])
                kinds = (pa.int32(), pa.string(), pa.binary(), pa.bool_())
                if rows or error:
                    book = batch.column("book_id").take(pa.array([at] * n))
                    yield pa.RecordBatch.from_arrays([book, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array([error] * n, pa.string())], names=["book_id", "ord", "path", "content", "stored", "error"])

    return books.select("book_id", "package").mapInArrow(run, f"book_id {kind}, ord int, path string, content binary, stored boolean, error string")


def _attempted(rewrite: Callable[..., object], kind: str, *columns: Column) -> Column:
    """struct(value, error): rewrite of a row's values, or why it failed; null in the first column gives nulls."""
    @F.pandas_udf(f"value {kind}, error string")
    def run(*given: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*given, strict=True):
            try:
                out.append((None if row[0] is None else rewrite(*row), None))
            except Exception as e:  # noqa: BLE001  that book's error
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame({"value": pd.Series([v for v, _ in out], dtype=object), "error": pd.Series([e for _, e in out], dtype=object)})

    return run(*columns)


def from_nav(src: Column) -> Column:
    """A place in the archive as the navigation document, in FOLDER, calls it."""
    return F.when(src.startswith(FOLDER), F.substring(src, F.lit(len(FOLDER) + 1), F.length(src))).otherwise(F.concat(F.lit("../"), src))


def navigation(points: Column, cover: Column, toc: Column, body: Column, language: str) -> Column:
    """The navigation document of points (array<struct<title, src>>, titles as markup) and of the landmarks that there are."""
    rows = F.transform(points, lambda e: concat("\t\t\t", element("li", [], element("a", [("href", from_nav(e["src"]))], e["title"]))))
    mark = lambda kind, src, label: F.when(src.isNotNull(), concat("\t\t\t", element("li", [], element("a", [("epub:type", kind), ("href", from_nav(src))], label))))
    marks = F.filter(F.array(mark("cover", cover, "Cover"), mark("toc", toc, "Table of Contents"), mark("bodymatter", body, "Start of Content")), lambda m: m.isNotNull())
    guide = F.when(F.size(marks) > 0, concat('\n\t<nav epub:type="landmarks" id="landmarks" hidden="">\n\t\t<h2>Guide</h2>\n\t\t<ol>\n', F.array_join(marks, "\n"), "\n\t\t</ol>\n\t</nav>\n"))
    lang = escape_xml(F.lit(language))
    return concat(
        '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="', lang, '" lang="', lang,
        f'">\n\n<head>\n\t<meta charset="utf-8" />\n\t<title>Table of Contents</title>\n\t<link rel="stylesheet" type="text/css" href="{CSS}" />\n</head>\n\n<body>\n',
        '\t<nav epub:type="toc" id="toc">\n\t\t<h1>Table of Contents</h1>\n\t\t<ol>\n', F.array_join(rows, "\n"), "\n\t\t</ol>\n\t</nav>\n", guide, "</body>\n\n</html>\n",
    )


def _kind(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))
    return F.when(ending == "opf", "opf").when(ending == "ncx", "ncx").when(ending.isin("html", "xhtml"), "page")


def described(entries: DataFrame) -> DataFrame:
    """book_id, ncx_ord, points, cover, toc, body, error: what each book of entries says of itself."""
    ncx = F.when(_kind(F.col("path")) == "ncx", F.struct("ord", F.col("content").cast("string").alias("text")))
    books = entries.groupBy("book_id").agg(F.min(ncx).alias("n"), F.max(F.when(F.col("path") == COVER, COVER)).alias("cover"), F.max("error").alias("broken"))
    read = books.withColumn("p", _attempted(packages.nav_points, "array<struct<title:string,src:string>>", F.col("n.text")))
    points = F.col("p.value")
    first = lambda pattern: F.get(F.filter(points, lambda e: e["src"].rlike(pattern)), F.lit(0))["src"]
    error = F.coalesce("broken", F.when(F.col("n").isNull(), "the package has no navigation map"), F.col("p.error"))
    return read.select("book_id", F.col("n.ord").alias("ncx_ord"), points.alias("points"), "cover", first(TOC_END).alias("toc"), F.coalesce(first(CHAPTER_END), F.get(points, F.lit(0))["src"]).alias("body"), error.alias("error"))


def _page(html: str, language: str) -> str:
    """A page of XHTML 1.1 as XHTML5 that links the style sheet."""
    lang = packages.escape(language, {'"': "&quot;"})
    if "<html" not in html:
        raise ValueError("anchor not found: <html")
    if not re.search("(?i)<!doctype[^>]*>", html):
        html = html.replace("<html", "<!DOCTYPE html>\n<html", 1)
    html = re.sub("(?i)<!doctype[^>]*>", "<!DOCTYPE html>", html, count=1)
    html = re.sub(r"""(?i)<meta\s+http-equiv=["']content-type["'][^>]*>""", '<meta charset="utf-8" />', html, count=1)
    html = re.sub(r"(?i)<html\b([^>]*)>", lambda m: "<html" + re.sub(r'\s+(?:xml:)?lang="[^"]*"', "", m[1]) + f' xml:lang="{lang}" lang="{lang}">', html, count=1)
    if "</head>" not in html:
        raise ValueError("anchor not found: </head>")
    return html.replace("</head>", f'\t<link rel="stylesheet" type="text/css" href="{CSS}" />\n</head>', 1)


def repackaged(entries: DataFrame, css: str, language: str = "en", modified: str = "1980-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """entries as `opened` gives them -> (entries of the same books in the newer format, failures(book_id, error)).

    The mimetype is first and stored; entries keep their order and all else is deflated; package documents, the first
    navigation map and pages are rewritten; the style sheet and a navigation document come last, in place of any that are
    there. A book fails as a whole, with its first error by the order of its entries."""
    entries = written(entries)  # else packages are opened again for each use
    own = entries.where("path is not null and path <> 'mimetype'").where(~F.col("path").isin(FOLDER + CSS, FOLDER + NAV))
    books = described(entries)
    known = own.join(books.where("error is null").select("book_id", "ncx_ord", "body"), "book_id")

    def rewrite(content: bytes, kind: str | None, path: str, start: str) -> bytes:
        if kind == "opf":
            folder = "" if path.startswith(FOLDER) else FOLDER
            return packages.PackageUpgrade(language, modified, start, folder)(content.decode()).encode()
        if kind == "ncx":
            return packages.Renumbered()(content.decode()).encode()
        return _page(content.decode(), language).encode()

    kind = F.when((_kind(F.col("path")) != "ncx") | (F.col("ord") == F.col("ncx_ord")), _kind(F.col("path")))
    # Images and the like needn't go through Python
    todo = known.withColumn("_k", kind).withColumn("_r", _attempted(rewrite, "binary", F.when(F.col("_k").isNotNull(), F.col("content")), F.col("_k"), F.col("path"), F.col("body")))
    made = written(todo.select("book_id", (F.col("ord") + 1).cast("long").alias("ord"), "path", F.when(F.col("_k").isNull(), F.col("content")).otherwise(F.col("_r.value")).alias("content"), F.col("_r.error").alias("error")))
    worse = made.where("error is not null").groupBy("book_id").agg(F.min_by("error", "ord").alias("error"))
    failed = books.where("error is not null").select("book_id", "error").unionByName(worse)
    good = books.where("error is null").join(worse.select("book_id"), "book_id", "left_anti")
    nav = navigation(F.col("points"), F.col("cover"), F.col("toc"), F.col("body"), language)
    last = 1 << 40
    extra = F.array(*[F.struct(F.lit(o).cast("long").alias("ord"), F.lit(p).alias("path"), c.cast("binary").alias("content")) for o, p, c in ((0, "mimetype", F.lit(MIMETYPE)), (last, FOLDER + CSS, F.lit(css)), (last + 1, FOLDER + NAV, nav))])
    added = good.select("book_id", F.explode(extra).alias("e")).select("book_id", "e.*")
    kept = made.drop("error").join(good.select("book_id"), "book_id", "left_semi")
    return kept.unionByName(added).withColumn("stored", F.col("path") == "mimetype"), failed
