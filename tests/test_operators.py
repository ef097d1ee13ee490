"""Boundary cases of the scalar functions and operators."""

import pytest
from pyspark.sql import functions as F

from folio.functions import js, text
from folio.operators import islands, joins, layout, markup, ordering, policy, retention, rules, sequence, vocabulary
from folio.sources import feeds, packages


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = [list(values.values()) or [1]]
    return spark.createDataFrame([tuple(v[0] if isinstance(v, list) and len(v) == 1 else v for v in row[0])], names).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("given", "wanted"), [("ﬁne ﬂow", "fine flow"), ("soft­hy​phen", "softhyphen"), ("a b", "a b"), ("x² ½ Ⅳ Ａ", "x² ½ Ⅳ Ａ")])
def test_normalize_characters(spark, given, wanted):
    assert one(spark, text.normalize_characters(F.col("t")), t=given) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("* * *", True), ("◇◇◇", True), ("---", True), ("#", True), ("*", False), ("-", False), ("...", False), ("***********", False), ("**********", True), ("*-*", False), ("abc", False), ("7", False), ("_ _ _", False), ("", False), ("🌟🌟🌟", False)],
)
def test_scene_break(spark, given, wanted):
    assert one(spark, text.is_scene_break(F.col("t")), t=given) is wanted
    assert markup.scene_break(given) is wanted


@pytest.mark.parametrize(("given", "wanted"), [("17", True), (" 3 of 40 ", True), ("Page 3 / 40", True), ("17 men", False), ("Page", False)])
def test_page_number(spark, given, wanted):
    assert one(spark, text.is_page_number(F.col("t")), t=given) is wanted


@pytest.mark.parametrize(("given", "wanted"), [('a/b:c*?"<>|', "a b c"), ("  ..x.. ", "x"), ("", "untitled"), (None, "untitled"), ("y" * 119 + ". z", "y" * 119)])
def test_filename(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(text.sanitize_filename(F.col("t"))).first()[0] == wanted


def test_js_boundaries(spark):
    assert one(spark, js.trim(F.col("t")), t=" ﻿ a \n") == "a"
    assert one(spark, js.rounded(F.col("x")), x=-2.5) == -2
    assert one(spark, js.utf16_length(F.col("t")), t="🌟a") == 3


@pytest.mark.parametrize(
    ("name", "num", "label"),
    [("Chapter 12.pdf", 12, "Chapter"), ("ch. 07 - x.pdf", 7, "Chapter"), ("Chapter_5.pdf", 5, None), ("Vol #3.pdf", 3, "Volume"), ("2,509 words.pdf", None, None), ("a 1234567.pdf", 123456, None), ("a 12345678.pdf", None, None), ("éch 3.pdf", 3, "Chapter"), ("none.pdf", None, None)],
)
def test_extract_number(spark, name, num, label):
    r = one(spark, sequence.extract_number(F.col("t")), t=name)
    if name.startswith("éch"):  # the boundary is ASCII, so é is one
        assert r["num"] == 3 and r["label"] == "Chapter"
    else:
        assert (r["num"], r["label"]) == (num, label)


@pytest.mark.parametrize(
    ("numbers", "ok", "missing"),
    [([1, 2, 4], True, [3]), ([1, 2], False, []), ([1, 2, 6], False, []), ([1, 3, 5], True, [2, 4]), ([1, 2, 3, None, None], True, []), ([1, 2, 3, None, None, None], False, []), ([5, 5, 5], False, []), ([1, 2, 3, 3], True, [])],
)
def test_sequence(spark, numbers, ok, missing):
    rows = [("g", i, n, "Chapter" if i % 2 else "Part") for i, n in enumerate(numbers)]
    r = sequence.analyze(spark.createDataFrame(rows, "g string, i int, num int, label string"), "g", "i").first()
    assert r["has_order"] is ok and r["missing"] == missing
    assert r["duplicates"] == ([3] if numbers == [1, 2, 3, 3] else [])
    if ok and len(numbers) == 4:
        assert r["label"] == "Part"  # as often as the other, but first


def test_number_ranges(spark):
    df = spark.createDataFrame([("a", n) for n in (27, 31, 32, 32, 40)], "g string, n int")
    assert islands.number_ranges(df, ["g"], "n").first()["ranges"] == "27, 31–32, 32, 40"


def test_dehyphenate(spark):
    rows = [("b", 1, "an inter- esting day, well- known and bright- ness"), ("b", 2, "it was interesting"), ("c", 1, "re- build"), ("c", 2, None), ("c", 3, "")]
    got = {(r["book_id"], r["block_no"]): r["text"] for r in vocabulary.dehyphenate(spark.createDataFrame(rows, "book_id string, block_no int, text string")).collect()}
    assert got["b", 1] == "an interesting day, well-known and brightness"
    assert got["c", 1] == "re-build" and got["c", 2] is None and got["c", 3] == ""


def test_running_heads(spark):
    rows = []
    for p in range(1, 5):
        for i, t in enumerate([f"Book {p}", "body", "more", "middle", "7", "tail a" if p % 2 else "tail b"]):
            rows.append(("x", p, i, t))
    lines = spark.createDataFrame(rows, "book_id string, page_no int, line_no int, text string")
    pages = spark.createDataFrame([("x", 4)], "book_id string, n_pages int")
    assert {r["key"] for r in layout.running_heads(lines, pages).collect()} == {"book #", "body", "#"}
    kept = layout.strip_running_heads(lines, pages).where("page_no = 1").orderBy("line_no")
    assert [r["text"] for r in kept.collect()] == ["more", "middle", "tail a"]
    more = spark.createDataFrame([("x", 9)], "book_id string, n_pages int")  # empty pages count
    assert layout.running_heads(lines, more).count() == 0


def test_lines_against_naive_scan(spark):
    glyphs = [("f", 1, 0, "world", 25.0, 10.0, 40.0, 100.0), ("f", 1, 1, "hello", 25.0, 10.0, 0.0, 103.0), ("f", 1, 2, "!", 5.0, 0.0, 65.0, 100.0), ("f", 1, 3, " ", 0.0, 10.0, 0.0, 50.0), ("f", 1, 4, "next", 20.0, 10.0, 0.0, 80.0), ("f", 1, 5, None, 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame([(*g[:6], [1.0, 0.0, 0.0, 1.0, g[6], g[7]]) for g in glyphs], "file_id string, page_no int, glyph_no int, str string, width double, height double, transform array<double>")
    assert [r["text"] for r in layout.reconstruct_lines(df).orderBy("line_no").collect()] == ["hello world!", "next"]


def test_blocks_and_stitching(spark):
    texts = [("• One", 10), ("Label", 10), ("• Two", 10), ("goes on", 10), ("Not a label", 10), ("prose here", 40), ("and more", 10), ("* * *", 40)]
    y, rows = 0.0, []
    for i, (t, step) in enumerate(texts):
        y -= step
        rows.append(("d", 1, i, y, 10.0, t))
    blocks = layout.assemble_blocks(spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, y double, height double, text string")).orderBy("block_no").collect()
    assert [(b["type"], b["text"]) for b in blocks] == [("li", "One"), ("p", "Label"), ("li", "Two goes on Not a label"), ("p", "prose here and more"), ("hr", "* * *")]  # only the line before counts
    parts = [("d", 1, 1, "p", "it was a"), ("d", 2, 1, "p", "dark night."), ("d", 3, 1, "p", "then"), ("d", 4, 1, "li", "item"), ("d", 5, 1, "p", "x")]
    joined = layout.stitch_pages(spark.createDataFrame(parts, "doc_id string, page_no int, block_no int, type string, text string")).orderBy("block_no").collect()
    assert [b["text"] for b in joined] == ["it was a dark night.", "then", "item", "x"]


def naive_order(posts):
    """posts: (position, date, number) of a newest-first listing."""
    base = posts[::-1]
    dated = [p for p in posts if p[1] is not None]
    if len(dated) >= 2 and len(dated) >= 0.8 * len(posts):
        key = lambda p: p[1]
    else:
        return base
    out, after, pred = [], {}, None
    for p in base:
        if key(p) is None:
            after.setdefault(pred, []).append(p)
        else:
            pred = p
    out += after.get(None, [])
    for p in sorted((p for p in base if key(p) is not None), key=lambda p: (key(p), p[2] or 0, base.index(p))):
        out += [p, *after.get(p, [])]
    return out


def test_oldest_first(spark):
    lists = {"a": [(0, 50, None), (1, 40, None), (2, None, None), (3, 30, None), (4, 35, None)], "b": [(0, None, None), (1, None, None), (2, 5, None)]}
    rows = [(k, *p, "newest-first") for k, ps in lists.items() for p in ps]
    got = ordering.oldest_first(spark.createDataFrame(rows, "list_id string, position int, date long, number double, order string")).orderBy("list_id", "pos").collect()
    for k, ps in lists.items():
        assert [r["position"] for r in got if r["list_id"] == k] == [p[0] for p in naive_order(ps)]
    up = [("c", i, i, None, "collection") for i in range(4)] + [("d", i, -i if i else 9, None, "collection") for i in range(6)]
    got = ordering.oldest_first(spark.createDataFrame(up, "list_id string, position int, date long, number double, order string")).orderBy("list_id", "pos").collect()
    assert [r["position"] for r in got if r["list_id"] == "c"] == [0, 1, 2, 3]
    assert [r["position"] for r in got if r["list_id"] == "d"] == [5, 4, 3, 2, 1, 0]


@pytest.mark.parametrize("options", [{"count_cap": 3}, {"count_cap": 50, "budget": 25}, {"count_cap": 2, "keep_at_least": 3}, {"count_cap": 4, "incoming_count": 2, "incoming_bytes": 5}, {}])
def test_prune(spark, options):
    rows = [("u", i, 100 - i % 3, 5 + i % 4) for i in range(6)]
    o = {"count_cap": 50, "budget": float("inf"), "incoming_bytes": 0, "incoming_count": 0, "keep_at_least": 0} | options
    left, total, gone = sorted(rows, key=lambda r: (r[2], r[1])), sum(r[3] for r in rows), []
    count = len(left)
    for r in left:
        if len(gone) >= max(0, len(rows) - o["keep_at_least"]) or not (count + o["incoming_count"] > o["count_cap"] or total + o["incoming_bytes"] > o["budget"]):
            break
        gone.append(r[1])
        total, count = total - r[3], count - 1
    df = spark.createDataFrame(rows, "u string, id int, created long, size int")
    got = retention.prune_victims(df, ["u"], "created", "id", F.col("size"), **options).orderBy("ord").collect()
    assert [r["id"] for r in got] == gone


def test_upsert_and_lookups(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, t string")
    assert sorted(map(tuple, retention.upsert(old, new, "id").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    none = old.where("false")
    assert joins.selected_or_all(old, none, "id").count() == 2 and joins.selected_or_all(old, new, "id").count() == 1
    assert joins.without(old, new, "id").count() == 1 and joins.without(none, new, "id").count() == 0


def test_percent_pairs_and_tags(spark):
    r = rules.Rules(rarities=[("epic", ["epic", "grand"])], keywords=[("good", ["not found", "ready"]), ("epic2", ["epic-grade"])])
    ratio = lambda t: one(spark, rules.percent_ratios(F.col("t"), r), t=t)
    assert ratio("30% of 60% then 10%") == [0.5, 1.0, 0.1]
    assert ratio("1% / 2% / 4%") == [0.5, 1.0, 0.04]
    assert ratio("5% of 0%") == [0.05, 0.0] and ratio("none") == []
    html = one(spark, rules.style_stat(F.col("t"), r), t="[ Grand ] [Epic] not-found & Epic-grade ready")
    assert '<span class="rarity-epic">[Epic]</span>' in html and '<span class="kw-good">not-found</span>' in html
    assert '<span class="rarity-epic">Epic-grade</span>' in html and "&amp;" in html  # the later rule wins
    assert one(spark, rules.normalize_hex(F.col("t")), t=" #AbC ") == "#aabbcc"
    assert one(spark, rules.normalize_hex(F.col("t")), t="red;}") is None
    assert one(spark, rules.check_color(F.col("t")), t="#ffffff")["fails"] == "light"


def test_html_blocks():
    page = '<h5 style="text-align:center">Top &amp; more</h5><script>var t="</p>";</script><p title="a>b">One <b>two</b><br><br/>three</p><blockquote><p>q</p></blockquote><ul><li>x</li></ul><p>* * *</p><hr><p> </p>tail &unknown; &#233;'
    b = markup.html_to_blocks(page)
    assert [(x["type"], x["text"], x["role"], x["align"]) for x in b] == [
        ("p", "Top & more", "h4", "center"), ("p", "One two three", None, None), ("p", "q", "blockquote", None), ("li", "x", None, None),
        ("hr", "* * *", None, None), ("hr", "* * *", None, None), ("p", "tail &unknown; é", None, None),
    ]
    assert [r["text"] for r in b[1]["runs"] if not r["br"]] == ["One ", "two", "three"] and sum(r["br"] for r in b[1]["runs"]) == 1
    assert markup.html_to_blocks("a" * 200_000 + "<p " + 'x="' + "y" * 100_000 + '">z')[-1]["text"] == "z"
    assert markup.html_to_blocks("") == []


def test_rich_text():
    doc = '{"type":"doc","content":[{"type":"heading","attrs":{"level":9},"content":[{"type":"text","text":"T"}]},{"type":"bulletList","content":[{"type":"list_item","content":[{"type":"paragraph","content":[{"type":"text","text":"i","marks":[{"type":"bold"}]}]}]}]},{"type":"horizontal_rule"}]}'
    assert [(b["type"], b["text"], b["role"]) for b in markup.rich_text_to_blocks(doc)] == [("p", "T", "h4"), ("li", "i", None), ("hr", "* * *", None)]
    assert markup.rich_text_to_blocks("{bad") is None and markup.rich_text_to_blocks('{"type":"doc"}') is None and markup.rich_text_to_blocks(None) is None


def test_blocks_column(spark):
    df = spark.createDataFrame([(1, "<p>a<i>b</i></p>"), (2, None)], "id int, html string")
    got = {r["id"]: r["blocks"] for r in markup.with_blocks(df, "html", markup.html_to_blocks).collect()}
    assert got[2] is None and got[1][0]["text"] == "ab"


def test_feeds(spark):
    good = '{"data":[{"id":"1","type":"post","attributes":{"title":"a"}},{"id":null,"type":"post"},{"id":"2","type":"user"}],"links":{"next":"n"}}'
    pages = spark.createDataFrame([("r", 0, good), ("r", 1, good), ("r", 2, '{"data":[{"id":"9","type":"post"}]}'), ("r", 3, "<html>"), ("r", 4, None)], "run_id string, page int, body string")
    rows = feeds.parse_pages(pages)
    assert rows.count() == 3 and [r["id"] for r in feeds.crawl(rows, pages).collect()] == ["1"]  # page 1 brings nothing new


def test_policy(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([1, 1, 1, 0, 1, *[1] * 11])], "u int, i int, f int")
    streaks = policy.failure_streaks(df, ["u"], ["i"], F.col("f") == 1)
    got = policy.pauses(streaks, ["u"]).orderBy("streak").collect()
    assert [(r["pauses"], r["seconds"], r["halted"]) for r in got] == [(1, 30, False), (3, 210, True)]
    outcomes = F.array(*[F.lit(x) for x in [True, False, *[True] * 20, *[True] * 20, *[True] * 20]])
    limits = one(spark, policy.pool_limits(outcomes))
    assert limits[0] == 3 and limits[1] == 1 and limits[21] == 2 and limits[41] == 3 and limits[61] == 3


def test_packages(spark):
    import io
    import zipfile

    chapters = spark.createDataFrame([(1, 0, "A & B", "<p>x</p>"), (1, 1, "C", "<p>y</p>")], "book_id long, ord int, title string, body string")
    row = packages.zip_books(packages.entries(chapters)).first()
    z = zipfile.ZipFile(io.BytesIO(bytes(row["package"])))
    first = z.infolist()[0]
    assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED and z.testzip() is None
    opf = z.read("OEBPS/content.opf").decode()
    assert all(n.split("/")[-1] in opf or n in ("mimetype", "META-INF/container.xml", "OEBPS/content.opf") for n in z.namelist())
    assert "A &amp; B" in z.read("OEBPS/nav.xhtml").decode()
    with pytest.raises(Exception, match="anchor not found"):
        one(spark, packages.first_or_fail(F.col("t"), "zz", "y"), t="abc")
    assert one(spark, packages.first_or_fail(F.col("t"), "b", "y"), t="abcb") == "aycb"
