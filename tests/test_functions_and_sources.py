"""Metadata detectors, line patterns, links, bytes and policies on literal rows."""

import io
import os
import random
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from lithic import sources
from lithic.functions import text as T


def values(spark, kind, rows, column):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_normalised(spark):
    texts = ["  Él_Niño--2025+%x ", "", "a\u00a0\tb", "ﬁ²"]
    got = values(spark, "t string", texts, T.normalised(F.col("t")))
    plain = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower() for t in texts]
    assert got[0] == "el nino 2025 x" and got[1] == "" and got[3] == plain[3]


def test_school(spark):
    cases = {"2025 acjc prelim": "ACJC", "Anderson Serangoon JC": "ASRJC", "anderson": "ASRJC", "St. Andrew's": "SAJC", "x-ri-y": "RI", "prime trial": "UNK", "raffles institution RI": "RI",
             "hci": "HCI", "ahci": "UNK", "Hwa-Chong": "HCI", "national junior": "NJC", "": "UNK", "Anglo-Chinese": "ACJC", "nus high vjc": "NUSH", "NJC mi": "NJC", "mi ri": "RI", "ri/mi": "RI"}
    assert values(spark, "t string", list(cases), T.school(T.normalised(F.col("t")))["code"]) == list(cases.values())
    assert len(T.aliases()) == 52 and len({a for a, _, _ in T.aliases()}) == 52


def test_years_papers_types(spark):
    assert values(spark, "t string", ["2025 and 2019", "20250", "1999", "2031 2030", "x2012y", "_2011_2012_", ""], T.year(F.col("t"))) == [2025, None, None, 2030, 2012, 2012, None]
    blob = T.normalised(F.col("t"))
    assert values(spark, "t string", ["H2 P1", "Paper 2", "Paper 2-1", "no", "1 QP", "2ms", "p3", "paper12"], T.paper_no(blob)) == [1, 2, 2, None, 1, 2, None, None]
    assert values(spark, "t string", ["a qp", "Solutions", "question and answers", "a paper", "P1_MS.pdf", "markers report", "mst", "QNS soln"], T.doc_type(blob)) == ["qp", "ms", "combined", "qp", "ms", "ms", "qp", "combined"]
    assert values(spark, "t string", ["Preliminary", "promo", "mid-year", "MYE", "common test", "ct", "act", ""], T.exam_type(blob)) == ["prelim", "promo", "mye", "mye", "ct", "ct", "prelim", "prelim"]


def test_names_and_keys(spark):
    row = spark.range(1).select(
        T.file_name(F.lit(2025), F.lit("RI"), F.lit("prelim"), F.lit(None).cast("int"), F.lit("qp")), T.file_name(F.lit(2025), F.lit("RI"), F.lit("prelim"), F.lit(2), F.lit("ms")),
        T.paper_key(F.lit("RI"), F.lit(2025), F.lit("prelim"), F.lit(None).cast("int")), T.exam_key(F.lit("RI"), F.lit(None).cast("int"), F.lit("promo")),
        T.source_url(F.lit("u"), F.lit("m.pdf")), T.source_url(F.lit("u"), F.lit(None).cast("string")), T.sidecar_path(F.lit("a.b/c.pdf")),
        T.display_ref(F.lit("RI"), F.lit(2025), F.lit(None).cast("int"), F.lit(3)), T.figure_height(F.lit(None).cast("double"), F.lit(None).cast("double")),
    ).first()
    assert list(row) == ["2025_RI_prelim_x_qp.pdf", "2025_RI_prelim_2_ms.pdf", "RI|2025|prelim|x", "RI|0|promo", "u#m.pdf", "u", "a.b/c.split.json", "RI 2025 P? Q3", 315]


def test_absolute_url(spark):
    base = "https://h.example.com/a/b?x"
    cases = {"c": "https://h.example.com/a/c", "/d": "https://h.example.com/d", "//e/f": "https://e/f", "http://g/": "http://g/"}
    df = spark.createDataFrame([(base, h) for h in cases] + [("https://h.example.com", "x")], "b string, h string")
    assert [r[0] for r in df.select(T.absolute_url(F.col("b"), F.col("h"))).collect()] == [*cases.values(), "https://h.example.com/x"]


def test_confidence_and_cards(spark):
    assert values(spark, "n int", [1, 2, 3, 4], T.rule_confidence(F.col("n"))) == [0.7, 0.85, 0.95, 0.95]
    card = T.card_line(F.col("m"), F.col("p"), F.col("a"), F.col("b"), F.lit("RI"))
    assert values(spark, "m int, p int, a int, b int", [(1, 0, 2, 2), (None, 2, 2, 3)], card) == ["1 mark · page 2 · RI", "2 parts · pages 2-3 · RI"]
    tags = values(spark, "t string", ["A:llm|B", "", None], T.parse_tags(F.col("t")))
    assert [[tuple(x) for x in t] for t in tags] == [[("A", "llm"), ("B", "rule")], [], []]


def test_decoding(spark):
    raw = [("\ufeffé".encode("utf-16-le"), None), ("é".encode(), None), ("\ufeffé".encode(), None), ("é".encode("latin-1"), "latin-1"), ("€".encode("cp1252"), None), ("é".encode("utf-16-be"), "utf-16-be"), (None, None), ("é".encode(), "nonsense"), ("\ufeffé".encode("utf-32-le"), None)]
    df = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(raw)], "i int, content binary, charset string")
    assert [r.text for r in sources.decoded(df).orderBy("i").collect()] == ["é", "é", "é", "é", "€", "é", None, "é", "é"]


def test_zip_listing_and_extraction(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/Q1.PDF", b"%PDF-1.4 hello")
        z.writestr("é.txt", b"x" * 1000)
    df = spark.createDataFrame([("u", b.getvalue()), ("tail", b.getvalue()[-400:]), ("bad", b"nothing")], "url string, content binary")
    got = sorted((r.id, r.name or "", r.size or 0, bool(r.is_pdf), r.error is not None) for r in sources.zip_listing(df).collect())
    assert got == [("bad", "", 0, False, True), ("tail", "a/Q1.PDF", 14, True, False), ("tail", "é.txt", 1000, False, False), ("u", "a/Q1.PDF", 14, True, False), ("u", "é.txt", 1000, False, False)]
    out = df.where("url = 'u'").withColumn("m", sources.extract_member(F.col("content"), F.lit("a/Q1.PDF"))).select(sources.is_pdf(F.col("m")), "m").first()
    assert out[0] and bytes(out[1]) == b"%PDF-1.4 hello"
    assert values(spark, "t string", ["a/b.pdf", "../x.pdf", "a/../b.pdf", "/x.pdf", "C:\\x.pdf", "a\\..\\b.pdf", "a..b.PDF", "x:y/a.pdf", "folder/", "a.txt", None], sources.safe_member(F.col("t"))) == [True, False, False, False, False, False, True, False, False, False, False]
    files = spark.createDataFrame([(_zip({"ok.pdf": b"%PDF-1", "not.pdf": b"hello", "../up.pdf": b"%PDF-1", "a.txt": b"%PDF-1"}),)], "content binary")
    assert [files.select(sources.extract_member(F.col("content"), F.lit(n))).first()[0] is not None for n in ("ok.pdf", "not.pdf", "../up.pdf", "a.txt", "missing.pdf")] == [True, False, False, False, False]


def _zip(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, raw in members.items():
            z.writestr(name, raw)
    return b.getvalue()


def test_links_resolve(spark):
    base = "http://h/a/b/c.php?q=1#f"
    cases = {"": "http://h/a/b/c.php?q=1", "?page=2": "http://h/a/b/c.php?page=2", "#t": "http://h/a/b/c.php?q=1#t", "../x": "http://h/a/x", "../../../x/": "http://h/x/", "./y": "http://h/a/b/y",
             "..": "http://h/a/", ".": "http://h/a/b/", "/p/../q?a=/../b": "http://h/q?a=/../b", "z/./w": "http://h/a/b/z/w", "//o/k": "http://o/k", "mailto:x": "mailto:x", "d/e": "http://h/a/b/d/e"}
    assert values(spark, "t string", list(cases), T.absolute_url(F.lit(base), F.col("t"))) == list(cases.values())
    assert values(spark, "t string", ["x", "?y"], T.absolute_url(F.lit("http://h"), F.col("t"))) == ["http://h/x", "http://h?y"]
    html = "<a id=1 href=/u?a=1&amp;b=2>x</a> <a data-href='n' href='it&#39;s'>y</a>"
    df = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert [r.link for r in sources.anchors(df).orderBy("pos").collect()] == ["http://h/u?a=1&b=2", "http://h/it's"]


def test_anchors_keep_order(spark):
    html = '<p><a href="/x">1</a> <A class=q HREF=\'y.html\'>2</A><a name=z>3</a><a href="#t">4</a>'
    df = spark.createDataFrame([(1, "http://h/d/", html), (2, "http://h/", None), (3, "http://h/", "")], "page_id long, url string, html string")
    assert [(r.page_id, r.pos, r.href, r.link) for r in sources.anchors(df).collect()] == [(1, 0, "/x", "http://h/x"), (1, 1, "y.html", "http://h/d/y.html"), (1, 2, "#t", "http://h/d/#t")]


def test_robots_and_schedule(spark):
    rules = [("h", 0, "*", "/ok", True), ("h", 1, "*", "/", False), ("g", 0, "Bot", "/", False), ("g", 1, "*", "/p", False), ("only", 0, "*", "/", False), ("e", 0, "*", "", False)]
    robots = spark.createDataFrame(rules, "host string, pos int, agent string, prefix string, allow boolean")
    urls = spark.createDataFrame([(1, "http://h/ok/1"), (2, "http://h/no"), (3, "http://g/p"), (4, "http://g/q"), (5, "http://new/"), (6, "http://only/x"), (7, "http://e/x")], "ord int, url string")
    ask = lambda *agents: {r.ord: r.allowed for r in sources.allowed(urls, robots, agents).collect()}
    # an agent without rules of its own follows those for all
    assert ask("bot/2.0", "*") == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: True}
    assert ask("bot") == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False, 7: True}
    assert ask("other") == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: True}
    times = spark.createDataFrame([("h", 1, 2.0), ("h", 2, 3.0), ("h", 3, 2.0), ("g", 1, 9.0)], "host string, ord int, delay double")
    assert sorted((r.host, r.ord, r.start_at) for r in sources.schedule(times).collect()) == [("g", 1, 0.0), ("h", 1, 0.0), ("h", 2, 2.0), ("h", 3, 5.0)]
    assert values(spark, "n int", [0, 3, 10], sources.backoff(F.lit(2.0), F.col("n"))) == [2.0, 16.0, 120.0]


def test_registry_and_config(tmp_path):
    @sources.register("demo")
    def demo(spark, cfg):
        return spark.range(1)

    assert sources.source("demo") is demo
    with pytest.raises(KeyError, match="demo"):
        sources.source("unknown")
    (tmp_path / "c.toml").write_text("[split]\npaper_marks = 80\n[other]\nx = 1\n")
    (tmp_path / ".env").write_text("# c\nLITHIC_TEST_A=1\nLITHIC_TEST_B='two'\n")
    os.environ["LITHIC_TEST_A"] = "kept"
    cfg = sources.load_config(tmp_path / "c.toml", tmp_path / ".env")
    assert cfg["split"]["paper_marks"] == 80 and cfg["split"]["gutter_tolerance"] == 6.0 and cfg["other"] == {"x": 1}
    assert os.environ["LITHIC_TEST_A"] == "kept" and os.environ["LITHIC_TEST_B"] == "two"


def test_candidates_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"n_groups": 1,\n "groups": [{"exam_key": "k", "links": [{"source": "s", "file_url": "u", "year": 2025, "paper_no": null}, {"source": "s", "file_url": "v"}]}]}')
    assert [(r.exam_key, r.file_url, r.year) for r in sources.candidate_links(spark, str(tmp_path / "c.json")).orderBy("file_url").collect()] == [("k", "u", 2025), ("k", "v", None)]
    assert sources.first_table(spark, [str(tmp_path / "none"), _table(spark, tmp_path)]).count() == 3
    with pytest.raises(FileNotFoundError):
        sources.first_table(spark, [str(tmp_path / "none")])


def _table(spark, tmp_path):
    path = str(tmp_path / f"t{random.random()}")
    spark.range(3).write.parquet(path)
    return path


def test_folding_holds_one_text_at_a_time():
    import tracemalloc

    import pandas as pd

    fold = T.fold_accents.func
    assert list(fold(pd.Series(["Élan ﬁn", None, "", "plain", "a\u0301\u20d7b"], dtype=object))) == ["Elan fin", None, "", "plain", "ab"]
    s = pd.Series([f"{k} " + "été à la crème " * 2000 for k in range(200)], dtype=object)  # 6 MB of one-byte characters, twice that decomposed
    tracemalloc.start()
    try:
        fold(s)
        assert tracemalloc.get_traced_memory()[1] < 1.5 * sum(map(len, s))
    finally:
        tracemalloc.stop()
