"""From page lines to questions, on literal lines and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lithic.operators import segment

LINES = "paper_id long, page int, top double, x0 double, text string, bottom double, page_height double, seq int"


def lines(spark, rows):
    return spark.createDataFrame([(p, page, float(top), float(x), t, float(top) + 12, 842.0, i) for i, (p, page, top, x, t) in enumerate(rows)], LINES)


def test_reading_order(spark):
    df = lines(spark, [(1, 2, 10, 5, "d"), (1, 1, 20.04, 9, "c"), (1, 1, 20.01, 5, "b"), (1, 1, 10, 50, "a")])
    assert [r.text for r in segment.reading_order(df).orderBy("line_index").collect()] == ["a", "b", "c", "d"]


def test_furniture(spark):
    rows = []
    for page in (1, 2):
        rows += [(1, page, 10, 56, "School  name"), (1, page, 400, 56, "body"), (1, page, 798, 294, str(page)), (1, page, 798, 56, str(page + 4)), (1, page, 780, 56, "[Turn over"), (1, page, 790, 200, f"9758/0{page}/X")]
    rows += [(2, 1, 10, 56, "once"), (2, 1, 400, 56, "x")]
    # papers of one page stay; short lines and numbers in the gutter may repeat; digits after a slash belong to a code, not to a word
    rows += [(3, p, 10, 56, t) for p in (1, 2) for t in ("5", "Qn 1", "3 A return over ten years is")] + [(4, 1, 10, 56, "[Turn over"), (4, 1, 790, 300, "1")]
    kept = [(r.paper_id, r.text) for r in segment.strip_furniture(lines(spark, rows)).collect()]
    assert sorted(kept) == [(1, "5"), (1, "6"), (1, "body"), (1, "body"), (2, "once"), (2, "x"), *[(3, "5")] * 2, *[(3, "Qn 1")] * 2, (4, "1"), (4, "[Turn over")]
    kept = [r.text for r in segment.strip_furniture(lines(spark, [(3, p, 10 * p, 56, t) for p in (1, 2) for t in ("3 A return over ten years is", "overturn overall") if p == 1] + [(3, 2, 300, 56, "x")])).collect()]
    assert sorted(kept) == ["3 A return over ten years is", "overturn overall", "x"]


def test_candidates(spark):
    rows = [(1, 1, 1, 300, "1 Cover text here"), (1, 1, 2, 56.6, "2 Find the value"), (1, 1, 3, 56.6, "3"), (1, 1, 4, 294.6, "4"), (1, 1, 5, 56.6, "5 ,"), (1, 1, 6, 56.6, "6) abc"), (1, 1, 7, 56.6, "7. ab"), (1, 1, 8, 56.6, "123 abc"), (1, 1, 9, 56.6, " 8 . ")]
    got = segment.candidates(segment.reading_order(lines(spark, rows))).orderBy("line_index").collect()
    assert [r.q_number for r in got] == [2, 3, 6]  # a numbered line with a short body is no bare number


def test_modal_gutter(spark):
    make = lambda xs: spark.createDataFrame([(1, i + 1, i, 1, float(x), "t") for i, x in enumerate(xs)], "paper_id long, q_number int, line_index int, page int, x0 double, text string")
    keep = lambda xs, tol=6.0: [r.x0 for r in segment.modal_gutter(make(xs), tol).orderBy("line_index").collect()]
    assert keep([72.02, 72.02, 99.02, 67.46]) == [72.02, 72.02, 67.46]
    assert keep([72.02, 99.02]) == [72.02, 99.02]
    assert keep([90, 50, 50, 90], 3.0) == [90, 90]


def brute_chain(qs):
    best = ((0, 0, 0, ()), ())
    for n in range(1, len(qs) + 1):
        for path in itertools.combinations(range(len(qs)), n):
            steps = [qs[b] - qs[a] for a, b in itertools.pairwise(path)]
            if qs[path[0]] in (1, 2) and all(s in (1, 2) for s in steps):
                gaps = (qs[path[0]] == 2) + sum(s == 2 for s in steps)
                key = (-n, gaps, path[-1], tuple(reversed(path)))
                if not best[1] or key < best[0]:
                    best = (key, path)
    return list(best[1]), best[0][1] if best[1] else 0


def test_chain(spark):
    rng = random.Random(1)
    cases = [[7, 1, 2, 3], [1, 2, 4, 5, 6], [2, 3, 4], [1, 2, 2, 1, 3], [], [9, 8], [2, 1, 3], [1, 3, 2, 4], [1, 1, 1]]
    cases += [[rng.randint(1, 6) for _ in range(rng.randint(0, 9))] for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, qs array<int>")
    got = [(list(r.c.path), r.c.gaps) for r in df.orderBy("i").select(segment.longest_chain(F.col("qs")).alias("c")).collect()]
    for case, g in zip(cases, got, strict=True):
        assert g == brute_chain(case), case


def test_missing_numbers(spark):
    df = spark.createDataFrame([([1, 4],), ([],), ([2],)], "f array<int>")
    assert [r[0] for r in df.select(segment.missing_numbers(F.col("f"))).collect()] == [[2, 3], [], [1]]


@pytest.fixture(scope="module")
def paper(spark):
    rows = [
        (1, 1, 100, 200, "Cover"), (1, 1, 150, 56, "1 (a) Find the value of x. [3]"), (1, 1, 170, 70, "(b) Hence show it. (2)"), (1, 1, 190, 70, "(b) again"),
        (1, 1, 700, 56, "2 Sketch the curve."), (1, 2, 100, 70, "(ii) State y. [4]"), (1, 2, 140, 300, "A"), (1, 2, 150, 56, "3"), (1, 2, 200, 70, "Prove it"), (1, 2, 240, 300, "12"),
    ]
    low = spark.createDataFrame([(1, [2])], "paper_id long, low_pages array<int>")
    q, p = segment.split_papers(lines(spark, rows + [(2, 1, 100, 56, "nothing here")]), low_pages=low)
    return {r.q_number: r for r in q.collect()}, {r.paper_id: r for r in p.collect()}


def test_questions(paper):
    q, _ = paper
    assert sorted(q) == [1, 2, 3]
    assert q[1].part_labels == ["(a)", "(b)"] and q[1].marks_total == 5 and q[3].marks_total is None
    assert (q[1].page_start, q[1].page_end, q[1].y_top, q[1].y_bottom) == (1, 1, 142.0, 210.0)
    assert (q[2].page_start, q[2].page_end, q[2].y_top, q[2].y_bottom) == (1, 2, 692.0, 120.0)
    assert (q[3].y_top, q[3].y_bottom) == (142.0, 220.0)
    assert q[2].full_text == "2 Sketch the curve.\n(ii) State y. [4]\nA"
    assert [q[i].needs_ocr for i in (1, 2, 3)] == [False, True, True]
    assert len({q[i].text_sha256 for i in q}) == 3


def test_scores_and_notes(paper):
    q, p = paper
    one, two = p[1], p[2]
    assert (one.n, one.n_gaps, one.total_marks, one.parse_status) == (3, 0, 9, "partial")
    assert one.numbering == 1.0 and one.sequence == 1.0 and one.marks == 0.667 and one["count"] == 0.0 and one.marks_sum == 0.0
    assert q[1].extract_confidence == one.confidence == round(0.2 + 0.15 + 0.25 * 2 / 3, 3)
    assert one.notes == ["3 questions detected, outside the expected 10-13", "marks total 9, expected 100", "little text on page(s) 2"]
    assert (two.n, two.confidence, two.parse_status, two.notes) == (0, 0.0, "failed", ["no incrementing question numbers found in the gutter"])


def test_slices(spark):
    df = spark.createDataFrame([(1, 2, 4, 30.0, 99.0, 842.0, 1000), (2, 1, 1, 5.0, 9.0, 842.0, 100)], "id int, page_start int, page_end int, y_top double, y_bottom double, page_height double, w int")
    got = [(r.id, r.page, r.y0, r.y1, r.scale_width) for r in segment.page_slices(df, "w").orderBy("id", "page").collect()]
    assert got == [(1, 2, 30.0, 842.0, 900), (1, 3, 0.0, 842.0, 900), (1, 4, 0.0, 99.0, 900), (2, 1, 5.0, 9.0, 320)]


def _planned(df):
    """The plan as run at first, without what running it adds."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_move_once(spark):
    """lines go to their paper once for the furniture and once for the questions, texts only where they are asked for."""
    rows = [(1, page, 10, 56, "School  name") for page in (1, 2)] + [(1, 1, 150, 56, "1 Find the value of x. [3]")]
    df = lines(spark, rows)
    chain = spark.createDataFrame([(1, [(1, 1)])], "paper_id long, starts array<struct<line_index int, q_number int>>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = segment.strip_furniture(df)
        moved = [l for l in _planned(kept).splitlines() if "Exchange hashpartitioning" in l]
        assert not any("paper_id" in l and "_flat" in l for l in moved)
        order = segment.reading_order(df).drop("seq")
        boxes = segment.questions(order, chain).select("paper_id", "q_number", "page_start", "page_end", "y_top", "y_bottom")
        plan = _planned(segment.segments(order, chain)).splitlines()
        assert not any("Exchange hashpartitioning" in l and "line_index" in l for l in plan)
        plan = _planned(boxes)
        after = plan[: plan.index("Union")]
        assert "text#" not in after
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_segments_against_the_join(spark):
    """Starts among the lines give the rows of a join by paper and line, papers without a start or without an id included."""
    rng = random.Random(5)
    numbered = [(p, i, f"t{i}") for p in (1, 2, 3, None) for i in range(9)]
    starts = [(p, [(i, 10 * i) for i in sorted(rng.sample(range(12), 3))]) for p in (1, 2, None, 7)]
    df = spark.createDataFrame(numbered, "paper_id long, line_index int, text string")
    chain = spark.createDataFrame(starts, "paper_id long, starts array<struct<line_index int, q_number int>>")
    got = sorted((r.paper_id, r.line_index, r.text, r.q_number, r.is_start) for r in segment.segments(df, chain).collect())
    expected = []
    for p, i, t in numbered:
        s = [at for at, _ in dict(starts).get(p, []) if at <= i and at < 9] if p is not None else []
        if s:
            expected.append((p, i, t, 10 * s[-1], i == s[-1]))
    assert got == sorted(expected)


def test_trimmed_lines(spark):
    """Only lines that may end in white space go through the pattern; the lines are those of the pattern on every line."""
    rng = random.Random(3)
    texts = ["".join(rng.choice([" ", "\t", "\r", "\x0b", "\x85", " ", "\xa0", "a", "\n", "é"]) for _ in range(rng.randint(0, 7))) for _ in range(3000)]
    d = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    plain = d.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text")).withColumn("text", F.regexp_replace("text", r"\s+$", "")).where("text != ''")
    assert sorted(map(tuple, segment.lines_of_text(d).collect())) == sorted(map(tuple, plain.collect()))


def test_low_text_of_the_counted_pages(spark):
    from lithic.operators import store

    rng = random.Random(9)
    df = lines(spark, [(rng.randint(1, 6), rng.randint(1, 5), rng.choice([10, 400, 800]), 56, rng.choice(["  ab ", "School name", "x" * 30, "7"])) for _ in range(120)])
    pages = df.groupBy("paper_id").agg(F.max("page").alias("pages"))
    both = [segment.split_papers(df, **how)[1].select("paper_id", "low_pages", "n_stripped", "notes").collect() for how in ({"low_text": 60}, {"low_pages": store.low_text_pages(df, pages, 60)})]
    assert sorted(map(tuple, both[0])) == sorted(map(tuple, both[1])) and any(r.low_pages for r in both[0])
