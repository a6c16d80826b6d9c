"""Fetching, link sources over fetched pages, the store's tables, and the session-free entry module."""

import io
import subprocess
import sys
import zipfile

from pyspark.sql import functions as F

from lithic.operators import store
from lithic.sources import fetch as fetching


def test_fetch(spark):
    def getter(url, form):
        if "down" in url:
            raise ConnectionError("no")
        if "busy" in url:
            return 503, {}, b""
        if "big" in url:
            return 200, {"content-length": "99"}, b"x"
        return (404, {}, b"") if "gone" in url else (200, {"content-type": "text/html; charset=latin-1"}, (form or "é").encode("latin-1"))

    urls = [("http://a/ok", None), ("http://a/busy", None), ("http://b/down", None), ("http://b/big", None), ("http://b/gone", None), ("http://b/post", "q=1")]
    out = fetching.fetch(spark.createDataFrame(urls, "url string, form string"), getter, max_bytes=50, max_retries=3, sleep=lambda s: None).cache()
    got = {r.url[9:]: (r.attempts, r.error) for r in out.collect()}
    assert got == {"ok": (1, None), "busy": (3, "HTTPError: 503"), "down": (3, "ConnectionError: no"), "big": (1, "TooLarge: 50 bytes or more"), "gone": (1, "HTTPError: 404"), "post": (1, None)}
    assert {(r.url[9:], r.html) for r in fetching.html_of(out).collect()} == {("ok", "é"), ("post", "q=1")}


def test_fetch_asks_the_rules_waits_and_ranges(spark):
    waits, seen = spark.sparkContext.accumulator(0.0), []

    def getter(url, form, headers=None):
        return 206 if headers else 200, {}, str(sorted((headers or {}).items())).encode()

    robots = spark.createDataFrame([("h", 0, "*", "/no", False)], "host string, pos int, agent string, prefix string, allow boolean")
    rows = [("http://h/no/1", None, None, 1.0), ("http://h/yes", 5, 9, 2.0), ("http://h/tail", 7, None, 0.0), ("http://h/all", None, None, 0.0)]
    out = fetching.fetch(spark.createDataFrame(rows, "url string, first long, last long, delay double"), getter, robots=robots, agents=("me/1.0",), sleep=lambda s: waits.add(s)).collect()
    assert {r.url[9:]: (r.status, r.error, r.content and bytes(r.content).decode()) for r in out} == {
        "no/1": (None, "RobotsDisallowed", None), "yes": (206, None, "[('Range', 'bytes=5-9')]"), "tail": (206, None, "[('Range', 'bytes=7-')]"), "all": (200, None, "[]"),
    }
    assert waits.value == 2.0 and not seen

    def busy(url, form):
        return 500, {}, b""

    waits = spark.sparkContext.accumulator(0.0)
    fetching.fetch(spark.createDataFrame([("http://h/x",)], "url string"), busy, max_retries=4, base_delay=3.0, sleep=lambda s: waits.add(s)).collect()
    assert waits.value == 3 + 6 + 12


def test_remote_archives_by_two_ranges(spark):
    whole = _zip("a.pdf", "b/c.pdf")
    big = _zip(*[f"folder/{i:05}.pdf" for i in range(300)])
    count = spark.sparkContext.accumulator(0)

    def getter(url, form, headers=None):
        raw = {"http://h/a.zip": whole, "http://h/big.zip": big, "http://h/not": b"hello"}.get(url)
        count.add(1)
        if raw is None:
            return 404, {}, b""
        if headers is None or url.endswith("not"):
            return 200, {}, raw
        first, _, last = headers["Range"].removeprefix("bytes=").rpartition("-")
        return (206, {}, raw[-int(last) :]) if not first else (206, {}, raw[int(first) : int(last) + 1])

    urls = spark.createDataFrame([("http://h/a.zip",), ("http://h/big.zip",), ("http://h/not",), ("http://h/gone",), ("http://h/a.zip",)], "url string")
    out = fetching.remote_members(urls, getter, tail=2000).collect()
    assert sorted(r.name for r in out if r.url.endswith("a.zip")) == ["a.pdf", "b/c.pdf"] and sum(r.url.endswith("big.zip") for r in out) == 300
    assert {r.url[9:]: r.error for r in out if r.error} == {"not": "no range: status 200", "gone": "HTTPError: 404"}


def test_seed_status_and_log(spark, tmp_path):
    topics = spark.createDataFrame([("A", "old", "pure"), ("X", "own", "stats")], "code string, name string, strand string")
    seed = spark.createDataFrame([("A", "new", "stats"), ("B", "b", "pure")], "code string, name string, strand string")
    assert sorted(map(tuple, store.seeded(topics, seed).collect())) == [("A", "new", "stats"), ("B", "b", "pure"), ("X", "own", "stats")]
    papers = spark.createDataFrame([(1, "ok", "n"), (2, "pending", None), (3, "ok", None)], "id long, parse_status string, parse_notes string")
    results = spark.createDataFrame([(1, "ok", ["n"]), (2, "partial", ["a", "b"])], "id long, parse_status string, notes array<string>")
    assert [tuple(r) for r in store.status_changes(papers, results).collect()] == [(2, "partial", "a; b")]
    assert sorted(map(tuple, store.next_status(papers, results).collect())) == [(1, "ok", "n"), (2, "partial", "a; b"), (3, "ok", None)]
    from lithic.operators import ingest

    for _ in range(2):
        ingest.append_crawl_log(topics, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_pages_and_compression(spark):
    from lithic import sources

    df = spark.createDataFrame([(1, b"x" * 100), (2, b"ab"), (3, None)], "paper_id long, content binary")

    def count(raw):
        return len(raw) // 10 if raw != b"ab" else int("no number")

    assert {r.paper_id: r.pages for r in sources.page_count(df, count).collect()} == {1: 10, 2: 0, 3: 0}

    def broken(raw):
        raise OSError

    out = {r.paper_id: (r.stored and len(r.stored), r.note) for r in sources.compressed(df, [lambda b: b[:30], broken, lambda b: b * 2], 50).collect()}
    assert out[1][0] == 30 and out[2] == (2, "small enough as it is") and out[3][0] is None


def _zip(*names):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in names:
            z.writestr(n, b"%PDF")
    return b.getvalue()


def test_archive_walk(spark):
    pages = [
        ("http://s/", '<a href="/2024">x</a><a href="/2025">y</a><a href="/2025b-2025">z</a><a href="/2019">old</a><a href="/about">w</a>'),
        ("http://s/2025", '<a href="/2025/ri">a</a><a href="/2025/hci">b</a><a href="/2025/ri">a</a>'), ("http://s/2024", '<a href="/2024/mi">c</a>'), ("http://s/2019", '<a href="/2019/vjc">c</a>'),
        ("http://s/2025/ri", '<a href="q.txt">q</a><a href="r.zip">r</a><a href="r2.zip">r</a>'), ("http://s/2025/hci", '<a href="/z/h.ZIP">h</a>'), ("http://s/2024/mi", '<a href="/z/m.zip">m</a>'),
    ]
    zips = [("http://s/2025/r.zip", _zip("Prelim P1 QP.pdf", "Prelim P1 MS.pdf", "notes.txt")), ("http://s/z/h.ZIP", _zip("p2.pdf")), ("http://s/z/m.zip", _zip("paper 1.pdf"))]
    walk = lambda n: fetching.archive_walk(spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame(zips, "url string, content binary"), "http://s/", name="walk", target=n)
    got = sorted((r.school_code, r.year, r.paper_no, r.doc_type, r.member) for r in walk(9).collect())
    assert got == [("HCI", 2025, 2, "qp", "p2.pdf"), ("MI", 2024, 1, "qp", "paper 1.pdf"), ("RI", 2025, 1, "ms", "Prelim P1 MS.pdf"), ("RI", 2025, 1, "qp", "Prelim P1 QP.pdf")]
    assert {r.school_code for r in walk(2).collect()} == {"RI", "HCI"}


def test_board_and_listing(spark):
    board = spark.createDataFrame([("http://b/1", "You must LOGIN first"), ("http://b/2", '<a href="?dlattach;id=1">RI 2025</a><a href="?dlattach;type=avatar">me</a>')], "url string, html string")
    links, errors = fetching.gated_board(board, ["http://b/1", "http://b/2"], name="b", phrases=("login first",))
    assert links.count() == 0 and errors.count() == 1
    links, errors = fetching.gated_board(board, ["http://b/2"], name="b", phrases=("login first",))
    assert [(r.doc_type, r.paper_no) for r in links.collect()] == [("combined", None)] and errors.count() == 0
    pages = [("http://l/1", '<a href="/d?id=7">H2 Maths RI 2025 P1</a><a href="/d?id=8">H2 Physics</a><a href="/x">H2 Maths</a>'), ("http://l/2", '<a href="/d?id=9">H2-Math <b>HCI</b> 2024</a>')]
    df = spark.createDataFrame(pages, "url string, html string")
    take = lambda n: sorted((r.item, r.school_code, r.year) for r in fetching.paged_listing(df, ["http://l/1", "http://l/2"], name="l", id_pattern=r"id=(\d+)", title_pattern=r"h2[\s\-]*maths?", target=n).collect())
    assert take(5) == [("7", "RI", 2025), ("9", "HCI", 2024)] and take(1) == [("7", "RI", 2025)]


def test_store(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS lithic_test")
    assert store.create_tables(spark, "lithic_test") == store.create_tables(spark, "lithic_test") == sorted(store.TABLES)
    old = spark.createDataFrame([(1, "qp", "a")], "id long, doc_type string, rel_path string")
    new = store.migrated(old, "papers")
    assert new.columns == spark.table("lithic_test.papers").columns and new.first().rel_path == "a"
    rows = new.unionByName(store.migrated(spark.createDataFrame([(2, "odd", "a"), (3, None, None)], "id long, doc_type string, rel_path string"), "papers"))
    assert sorted(map(tuple, store.violations(rows, "papers").collect())) == [("doc_type is not allowed", "odd", 1), ("rel_path is not unique", "a", 2)]
    done = store.next_status(new, spark.createDataFrame([(1, "ok", ["x", "y"])], "id long, parse_status string, notes array<string>")).first()
    assert (done.parse_status, done.parse_notes) == ("ok", "x; y")
    q = spark.createDataFrame([(1, 2, 1, 1, 3, ["(a)"], "two\nlines"), (1, 1, 1, 1, None, [], "one")], "paper_id long, q_number int, page_start int, page_end int, marks_total int, part_labels array<string>, full_text string")
    p = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "paper_id long, rel_path string")
    side = {r.paper_id: r for r in store.sidecars(q, p).collect()}
    assert [(x.q_number, x.first_line) for x in side[1].questions] == [(1, "one"), (2, "two")] and side[1].sidecar == "a.split.json" and side[2].questions is None
    store.write_sidecars(store.sidecars(q, p), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    assert store.stored_bytes(spark.createDataFrame([("a", b"abc")], "rel_path string, content binary")).first().size_bytes == 3


def test_extractor(spark):
    def extractor(raw):
        if raw == b"bad":
            raise ValueError
        return [(1, 1.0, 2.0, "a\xa0b  ", 3.0, 842.0), (1, 2.0, 2.0, "  ", 3.0, 842.0), (2, 1.0, 2.0, "x" * 60, 3.0, 842.0)]

    files = spark.createDataFrame([(1, b"ok"), (2, b"bad")], "paper_id long, content binary")
    lines = store.extract_lines(files, extractor).cache()
    assert [(r.seq, r.text[:3]) for r in lines.orderBy("seq").collect()] == [(0, "a b"), (1, "xxx")]
    low = store.low_text_pages(lines, spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "paper_id long, pages int"))
    assert {r.paper_id: list(r.low_pages) for r in low.collect()} == {1: [1], 2: [1]}


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50; print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 50


def test_entry_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).where(F.col("ms_path").isNotNull()).limit(1).count() == 1
