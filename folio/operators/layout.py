"""From positioned fragments to lines, pages without running heads, blocks and chapters."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import js, text
from folio.operators.islands import islands, joined_text
from folio.runtime import slices, written

EDGE_LINES = 2
REPEAT_SHARE = 0.5
MIN_REPEAT_PAGES = 3
PARAGRAPH_GAP = 1.8
BUCKET = 8.0
_SPACES = re.compile(r"[\s\ufeff]+")
LINES = "file_id string, page_no int, line_no int, y double, height double, text string"
PACKS = "file_id string, page_no int, n int, size int, pack binary"
PACK_BYTES = 1 << 18
#: Rows of an unpacked pack: the bytes of glyph_no, width, height, x, y, and of the text's size.
_FIELDS, _ROWS = 5, 44
#: The bits of a double that stand for null: a NaN that no arithmetic makes.
_NULL = np.uint64(0x7FF8DEADBEEF0001)


def page_lines(glyphs: Iterable[tuple]) -> list[tuple[float, float, str]]:
    """(y, height, text) of the lines of one page of glyphs (str, width, height, x, y), in order of arrival: a fragment joins the
    first line made whose baseline is within half the larger height, else it makes one. The spec is sequential, so a page
    is one pass in Python, which looks at lines near the fragment alone."""
    made: list[list] = []  # y, height and parts of each line
    by_height: dict[int, list[int]] = {}  # numbers of lines by the place of their baseline
    tallest = 0.0
    for s, width, height, x, y in glyphs:
        s = s or ""
        width = 0.0 if width is None or width != width else width
        if not s.strip() and not width > 0:
            continue
        h = height if height and height == height else 10.0
        reach = 0.5 * max(tallest, h)
        at = None
        for b in range(int((y - reach) // BUCKET), int((y + reach) // BUCKET) + 1):
            for i in by_height.get(b, ()):
                if (at is None or i < at) and abs(made[i][0] - y) <= 0.5 * max(made[i][1], h):
                    at = i
        if at is None:
            at = len(made)
            made.append([y, h, []])
            by_height.setdefault(int(y // BUCKET), []).append(at)
        line = made[at]
        tallest = max(tallest, h)
        line[1] = max(line[1], h)
        line[2].append((x, width, height, s))
    out = []
    for y, line_height, parts in sorted(made, key=lambda m: -m[0]):
        so_far, end = [], None
        for x, width, height, s in sorted(parts, key=lambda p: p[0]):
            h = height if height and height == height else line_height
            last = next((p for p in reversed(so_far) if p), "")
            if end is not None and x - end > 0.25 * h and not last.endswith(" "):
                so_far.append(" ")
            so_far.append(s)
            end = x + width
        whole = _SPACES.sub(" ", "".join(so_far)).strip()
        if whole:
            out.append((y, line_height, whole))
    return out


def _starts(batch) -> np.ndarray:
    """Rows of a batch, sorted by page, where a page begins; the first is 0."""
    import pyarrow.compute as pc

    n, differ = batch.num_rows, np.zeros(max(batch.num_rows - 1, 0), bool)
    for c in batch.columns[:2]:
        here, before = c.slice(1), c.slice(0, n - 1)
        differ |= pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(differ) + 1])


def _spaced_pages(batch, starts: np.ndarray) -> tuple[np.ndarray, list]:
    """Pages (numbers in `starts`) whose baselines are equal or farther apart than half the tallest fragment, in all of which
    fragments have a width and a text, and the lines of those: page, y, height, text. There a fragment can join the line of its
    own baseline alone, so the order of arrival decides nothing, and lines of many pages are made at once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pc.fill_null(batch.column(2), "")
    width, height, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns[3:])
    known = (height == height) & (height != 0)
    own = np.where(known, height, 10.0)
    sizes = np.diff(np.append(starts, batch.num_rows))
    page = np.repeat(np.arange(len(starts)), sizes)
    usual = (width > 0) & np.isfinite(width) & np.isfinite(own) & (own > 0) & np.isfinite(x) & np.isfinite(y) & (pc.binary_length(words).to_numpy() > 0)
    good = np.logical_and.reduceat(usual, starts)
    order = np.lexsort((x, -y, page))
    y, tallest = y[order], np.maximum.reduceat(own, starts)
    same = page[1:] == page[:-1]
    step = y[:-1] - y[1:]
    good[page[1:][same & (step != 0) & ~(step > 0.5 * tallest[page[1:]])]] = False
    order, y = order[good[page]], y[good[page]]
    if not len(order):
        return good, [[], [], [], []]
    page, x, width, own, known = page[order], x[order], width[order], own[order], known[order]
    words = words.take(pa.array(order))
    begins = np.concatenate([[True], (page[1:] != page[:-1]) | (y[1:] != y[:-1])])
    first = np.flatnonzero(begins)
    tall = np.maximum.reduceat(own, first)
    line = np.cumsum(begins) - 1
    space = np.zeros(len(order), bool)
    space[1:] = (x[1:] - (x + width)[:-1] > 0.25 * np.where(known, own, tall[line])[1:]) & ~pc.ends_with(words, " ").to_numpy(zero_copy_only=False)[:-1] & ~begins[1:]
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(space), " ", ""), words, "")
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pieces), "")
    return good, [page[first].tolist(), y[first].tolist(), tall.tolist(), [_SPACES.sub(" ", t).strip() for t in whole.to_pylist()]]


def _bits(column) -> np.ndarray:
    bits = np.array(column.to_numpy(zero_copy_only=False), np.float64).view(np.uint64)
    bits[column.is_null().to_numpy(zero_copy_only=False)] = _NULL
    return bits


def _packed(batch):
    """A batch of glyphs (file_id, page_no, glyph_no, str, width, height, x, y) as a row for each run of one page: fields by
    planes of bytes, most of which are alike, then the texts; compressed unless there are few. A glyph takes a fraction of its row."""
    import pyarrow as pa
    import pyarrow.compute as pc

    starts = _starts(batch)
    if len(starts) * 16 > batch.num_rows:  # pages are mixed, or small
        batch = batch.sort_by([("file_id", "ascending"), ("page_no", "ascending")])
        starts = _starts(batch)
    n, words, zstd = batch.num_rows, batch.column(3), pa.Codec("zstd", 3)
    number = pc.fill_null(batch.column(2), -(1 << 63)).to_numpy(zero_copy_only=False)
    fields = [np.ascontiguousarray(number, np.int64).view(np.uint64), *map(_bits, batch.columns[4:])]
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + n + 1]
    data = memoryview(data or b"")
    sizes = np.diff(offsets).astype(np.uint32)
    planes = np.concatenate([*(f.view(np.uint8).reshape(n, 8).T for f in fields), sizes.view(np.uint8).reshape(n, 4).T])
    ends = np.append(starts[1:], n)
    packs, whole = [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        raw = planes[:, a:b].tobytes() + bytes(data[offsets[a] : offsets[b]])
        whole.append(len(raw))
        packed = zstd.compress(raw, asbytes=True) if b - a >= 16 else raw
        packs.append(packed if len(packed) < len(raw) else raw)
    first = pa.array(starts)
    return pa.RecordBatch.from_arrays([batch.column(0).take(first), batch.column(1).take(first), pa.array(ends - starts, pa.int32()), pa.array(whole, pa.int32()), pa.array(packs, pa.binary())], names=["file_id", "page_no", "n", "size", "pack"])


def _unpacked(packs):
    """file_id, page_no, str, width, height, x, y of the glyphs of whole pages, sorted by page, in the order of arrival."""
    import pyarrow as pa

    starts = _starts(packs)
    page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, packs.num_rows)))
    counts = packs.column("n").to_numpy()
    raw = [x if len(x) == size else pa.decompress(x, size, "zstd", asbytes=True) for x, size in zip(packs.column("pack").to_pylist(), packs.column("size").to_pylist(), strict=True)]
    planes = np.concatenate([np.frombuffer(x, np.uint8, _ROWS * n).reshape(_ROWS, n) for x, n in zip(raw, counts.tolist(), strict=True)], axis=1)
    fields = [np.ascontiguousarray(planes[8 * k : 8 * k + 8].T).view(np.uint64).ravel() for k in range(_FIELDS)]
    sizes = np.ascontiguousarray(planes[8 * _FIELDS :].T).view(np.uint32).ravel()
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(b"".join([x[_ROWS * n :] for x, n in zip(raw, counts.tolist(), strict=True)])))
    order = pa.array(np.lexsort((fields[0].view(np.int64), np.repeat(page, counts))))
    of = pa.array(np.repeat(np.arange(packs.num_rows), counts))
    columns = [packs.column(0).take(of), packs.column(1).take(of), words, *(pa.array(f.view(np.float64), mask=f == _NULL) for f in fields[1:])]
    return pa.RecordBatch.from_arrays([c.take(order) for c in columns], names=["file_id", "page_no", "str", "width", "height", "x", "y"])


def packed_pages(glyphs: DataFrame) -> DataFrame:
    """glyphs(file_id, page_no, glyph_no, str, width, height, transform) packed, a row or more for each page."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                yield _packed(batch)

    kept = glyphs.where("str is not null")
    rows = kept.select(F.col("file_id").cast("string").alias("file_id"), F.col("page_no").cast("int").alias("page_no"), F.col("glyph_no").cast("long").alias("glyph_no"), "str", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.get("transform", F.lit(4)).cast("double").alias("x"), F.get("transform", F.lit(5)).cast("double").alias("y"))
    return rows.mapInArrow(run, PACKS)


def reconstruct_lines(glyphs: DataFrame) -> DataFrame:
    """glyphs(file_id, page_no, glyph_no, str, width, height, transform) -> lines; pages are independent."""
    return lines_with_edges(glyphs).drop("is_edge")


def lines_with_edges(glyphs: DataFrame) -> DataFrame:
    """reconstruct_lines with is_edge, as edge_lines has it. Glyphs are packed before they are dealt by page, so that the exchange
    and its sort hold few small rows, and pages follow each other through Arrow batches. Pages of well-spaced lines are made
    many at once, others one by one in the order of arrival."""
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
    names = ["file_id", "page_no", "line_no", "y", "height", "text", "is_edge"]

    def lines(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = _unpacked(held[0] if len(held) == 1 else pa.concat_batches(held))
        starts = _starts(batch)
        good, (page, y, height, texts) = _spaced_pages(batch, starts)
        found, number, last = [], 0, -1
        for row in zip(page, y, height, texts, strict=True):
            number, last = (0 if row[0] != last else number), row[0]
            if row[3]:
                found.append((row[0], number, *row[1:]))
                number += 1
        ends = np.append(starts[1:], batch.num_rows)
        for p in np.flatnonzero(~good).tolist():
            glyphs = zip(*(c.slice(starts[p], ends[p] - starts[p]).to_pylist() for c in batch.columns[2:]), strict=True)
            found += [(p, i, *line) for i, line in enumerate(page_lines(glyphs))]
        of, *made = list(zip(*found, strict=True)) if found else [[]] * 5
        of = np.array(of, np.int64)
        at = np.array(made[0], np.int64)
        is_edge = (at < EDGE_LINES) | (at >= np.bincount(of)[of] - EDGE_LINES) if len(of) else np.empty(0, bool)
        of = pa.array(starts[of])
        return pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns[:2]), *(pa.array(c, k) for c, k in zip(made, kinds[2:], strict=True)), pa.array(is_edge)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of whole pages, and of the last one as far as it has come
        for batch in (part for whole in batches if whole.num_rows for part in slices(whole, "pack", PACK_BYTES)):
            cut = int(_starts(batch)[-1])
            if cut:
                yield lines([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            elif held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in (0, 1)):
                yield lines(held)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield lines(held)

    placed = packed_pages(glyphs).repartition("file_id", "page_no").sortWithinPartitions("file_id", "page_no")
    return placed.mapInArrow(run, f"{LINES}, is_edge boolean")


def edge_lines(lines: DataFrame, book: str = "book_id", page: str = "page_no", line: str = "line_no") -> DataFrame:
    """lines with is_edge: among the first or last two of its page. Lines that have it already stay as they are."""
    if "is_edge" in lines.columns:
        return lines
    n = F.count("*").over(Window.partitionBy(book, page))
    at = F.row_number().over(Window.partitionBy(book, page).orderBy(line)) - 1
    return lines.withColumn("is_edge", (at < EDGE_LINES) | (at >= n - EDGE_LINES))


def running_heads(lines: DataFrame, pages: DataFrame, share: float = REPEAT_SHARE, least: int = MIN_REPEAT_PAGES) -> DataFrame:
    """book_id, key, pages of what stands at the edge of more than `share` of a book's pages and of `least` at least.
    pages(book_id, n_pages) counts empty pages too."""
    keyed = edge_lines(lines).where("is_edge").withColumn("key", text.header_key(F.col("text"))).where("key <> ''")
    seen = keyed.groupBy("book_id", "key").agg(F.countDistinct("page_no").alias("pages"))
    return seen.join(pages, "book_id").where((F.col("pages") >= least) & (F.col("pages") > share * F.col("n_pages"))).select("book_id", "key", "pages")


def strip_running_heads(lines: DataFrame, pages: DataFrame, share: float = REPEAT_SHARE, least: int = MIN_REPEAT_PAGES) -> DataFrame:
    """lines without running heads and page numbers at the edges. Lines are read twice; write those that are dear to make. Of lines
    with is_edge those at the edges alone are looked up, and the others aren't dealt out for it."""
    if "is_edge" in lines.columns:
        rest = [c for c in lines.columns if c != "is_edge"]
        inside, edges = lines.where("not is_edge").select(rest), lines.where("is_edge").select(rest)
        keyed = edges.withColumn("key", text.header_key(F.col("text"))).where(~F.coalesce(text.is_page_number(F.col("text")), F.lit(False)))
        return inside.unionByName(keyed.join(running_heads(lines, pages, share, least).select("book_id", "key"), ["book_id", "key"], "left_anti").select(rest))
    edged = edge_lines(lines).withColumn("key", text.header_key(F.col("text")))
    numbered = F.col("is_edge") & text.is_page_number(F.col("text"))
    heads = running_heads(lines, pages, share, least).select("book_id", "key", F.lit(True).alias("is_edge"))
    return edged.where(~F.coalesce(numbered, F.lit(False))).join(heads, ["book_id", "key", "is_edge"], "left_anti").drop("key", "is_edge")


def assemble_blocks(lines: DataFrame, doc: str = "doc_id", page: str = "page_no", line: str = "line_no") -> DataFrame:
    """doc, page, block_no, type (p, li, hr), text, n_lines: wrapped lines joined; a bullet, a wide gap and what follows a bullet
    without going on in lower case begin a block. A document's lines are sorted once."""
    w = Window.partitionBy(doc).orderBy(page, line)
    bullet = text.is_bullet(F.col("text"))
    seen = lines.withColumns({"_bullet": bullet}).withColumns({"_py": F.lag("y").over(w), "_ph": F.lag("height").over(w), "_pb": F.lag("_bullet").over(w), "_pp": F.lag(page).over(w)})
    gap = F.col("_py") - F.col("y") > F.col("_ph") * PARAGRAPH_GAP
    starts = F.col("_py").isNull() | (F.col("_pp") != F.col(page)) | F.col("_bullet") | gap | (F.col("_pb") & ~F.col("text").rlike("^[a-z]"))
    blocks = islands(seen.withColumn("_starts", starts), [doc], [page, line], F.col("_starts"), "block_no")
    made = blocks.groupBy(doc, "block_no").agg(F.min(page).alias(page), joined_text(F.col("text"), F.struct(page, line)).alias("text"), F.min_by("_bullet", F.struct(page, line)).alias("_bullet"), F.count("*").alias("n_lines"))
    whole = F.when(F.col("_bullet"), text.strip_bullet(F.col("text"))).otherwise(F.col("text"))
    kind = F.when(F.col("_bullet"), "li").when(text.is_scene_break(F.col("text")), "hr").otherwise("p")
    return made.select(doc, page, "block_no", kind.alias("type"), whole.alias("text"), "n_lines")


def stitch_pages(blocks: DataFrame, doc: str = "doc_id", page: str = "page_no", block: str = "block_no") -> DataFrame:
    """doc, block_no, type, text: a paragraph cut by a page's end is joined with what goes on in lower case."""
    w = Window.partitionBy(doc).orderBy(page, block)
    seen = blocks.withColumns({"_pt": F.lag("type").over(w), "_px": F.lag("text").over(w), "_pp": F.lag(page).over(w)})
    ended = F.col("_px").rlike(rf"[.!?…\"”’'\]]{js.WS}*\z")
    goes_on = (F.col("_pp") != F.col(page)) & (F.col("_pt") == "p") & (F.col("type") == "p") & ~ended & F.col("text").rlike(r"^\p{Ll}")
    joined = islands(seen.withColumn("_starts", ~F.coalesce(goes_on, F.lit(False))), [doc], [page, block], F.col("_starts"), "_new")
    return joined.groupBy(doc, "_new").agg(F.min_by("type", F.struct(page, block)).alias("type"), joined_text(F.col("text"), F.struct(page, block)).alias("text")).withColumnRenamed("_new", "block_no")


def chapter_blocks(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Glyphs of files and pages(file_id, n_pages) to the blocks of chapters: lines, heads off, blocks, pages stitched. Lines are
    made once and written; what was dealt out for them goes from the disk before they are dealt out again."""
    lines = written(lines_with_edges(glyphs).withColumnRenamed("file_id", "book_id"), compression="zstd", tidy=True)
    kept = strip_running_heads(lines, pages.withColumnRenamed("file_id", "book_id"))
    return stitch_pages(assemble_blocks(kept, "book_id"), "book_id").withColumnRenamed("book_id", "file_id")
