"""Lines of many pages at once against lines of one page in the order of arrival."""

import random

import pyarrow as pa

from folio.operators import layout


def pages_of(seed, n):
    """Pages of glyphs; odd ones have lines that overlap, fragments without width or text, and heights that are none."""
    rnd = random.Random(seed)
    nan, out = float("nan"), []
    for i in range(n):
        odd = rnd.random() < 0.4
        texts = ["a", "bc ", " d", "e  f", "é", "﻿", " ", "g\t", *(["", "  "] if odd else [])]
        heights, widths = [10.0, 8.0, 12.0, None, 0.0, nan, *([-3.0, 40.0] if odd else [])], [5.0, 1.0, 20.0, *([None, 0.0, -1.0, nan] if odd else [])]
        places = [0.0, -20.0, -40.0, -60.0, *([-33.5, -7.0] if odd else [])]
        out.append([(rnd.choice(texts), rnd.choice(widths), rnd.choice(heights), float(rnd.randrange(60)), rnd.choice(places)) for _ in range(rnd.randrange(1, 30))])
    return out


def test_spaced_pages():
    pages = pages_of(1, 300)
    rows = [(f"f{i // 3}" if i else None, i % 3, *g) for i, p in enumerate(pages) for g in p]
    kinds = [pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list("abcdefg"))
    good, (page, *lines) = layout._spaced_pages(batch, layout._starts(batch))
    got = [[] for _ in pages]
    for p, y, height, text in zip(page, *lines, strict=True):
        if text:
            got[p].append((y, height, text))
    assert 100 < good.sum() < 300
    assert [g for g, ok in zip(got, good, strict=True) if ok] == [layout.page_lines(p) for p, ok in zip(pages, good, strict=True) if ok]


def test_pages_over_arrow_batches(spark):
    pages = pages_of(2, 60)
    rows = [(f"f{i // 4}" if i > 3 else None, i % 4, k, s, w, h, [1.0, 0.0, 0.0, 1.0, x, y]) for i, p in enumerate(pages) for k, (s, w, h, x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "file_id string, page_no int, glyph_no int, str string, width double, height double, transform array<double>")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = {tuple(r) for r in layout.reconstruct_lines(df.repartition(5)).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {(f"f{i // 4}" if i > 3 else None, i % 4, k, *line) for i, p in enumerate(pages) for k, line in enumerate(layout.page_lines(p))}


def test_packs_come_back_in_the_order_of_arrival():
    nan, rnd = float("nan"), random.Random(3)
    rows = [(None if i % 7 == 0 else f"f{i % 7}", i % 3, rnd.randrange(1 << 30) if i % 11 else None, ["", "é", "a b", "x" * 300][i % 4], [1.5, None, nan][i % 3], [10.0, 0.0, None][i % 3], [None, 2.0, -0.5][i % 3], [-12.0, nan][i % 2]) for i in range(2000)]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), *[pa.float64()] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file_id", "page_no", "glyph_no", "str", "width", "height", "x", "y"])
    packs = pa.Table.from_batches([layout._packed(b) for b in (batch.slice(0, 900), batch.slice(900, 7), batch.slice(907))]).sort_by([("file_id", "ascending"), ("page_no", "ascending")]).combine_chunks().to_batches()[0]
    key = lambda r: (r[0] is None, r[0] or "", r[1], r[2] is not None, r[2] or 0)
    got = list(zip(*layout._unpacked(packs).to_pydict().values(), strict=True))
    want = [(*r[:2], *r[3:]) for r in sorted(rows, key=key)]
    groups = lambda many: sorted(map(repr, many))  # noqa: E731  those without a number come in any order
    assert groups(got) == groups(want)
    assert [repr(g) for g, r in zip(got, sorted(rows, key=key), strict=True) if r[2] is not None] == [repr(w) for w, r in zip(want, sorted(rows, key=key), strict=True) if r[2] is not None]


def test_packs_are_small(spark):
    glyphs = spark.range(8000).selectExpr("'f' file_id", "int(id / 400) page_no", "int(pmod(xxhash64(id), 1 << 30)) glyph_no", "md5(cast(id % 97 as string)) str", "160d width", "10d height", "array(1d, 0d, 0d, 1d, id % 8 * 1000d, -12d * floor(id % 400 / 8)) transform")
    packs = layout.packed_pages(glyphs.coalesce(1)).collect()
    assert sum(r["n"] for r in packs) == 8000 and len(packs) <= 21
    assert sum(len(r["pack"]) for r in packs) < 8000 * 20
