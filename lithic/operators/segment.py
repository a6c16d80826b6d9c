"""From positioned page lines to numbered questions.

All stages are windows or aggregations on the paper: after one hash
partitioning by ``paper_id`` they need no further exchange.  Lines have
paper_id, page, top, x0, text, bottom, page_height.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from pyspark.sql.window import Window

from lithic.functions import text as T
from lithic.operators import store, tables

_CHAIN = StructType().add("path", ArrayType(IntegerType())).add("gaps", IntegerType())


def _paper():
    return Window.partitionBy("paper_id")


# ------------------------------------------------------------------ lines
def reading_order(lines: DataFrame) -> DataFrame:
    """line_index (from 0) by page, top to one decimal, x0; equal places by the order column `seq` where there is one, else by text."""
    tie = "seq" if "seq" in lines.columns else "text"
    w = _paper().orderBy("page", F.bround("top", 1), "x0", tie)
    return lines.withColumn("line_index", F.row_number().over(w) - 1)


def lines_of_text(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of plain texts as (paper_id, seq, text): right-trimmed, blank ones dropped."""
    lines = documents.select(F.col(id_col).alias("paper_id"), F.posexplode(F.split(text_col, "\n")).alias("seq", "text")).where(F.rlike("text", F.lit(r"\S")))
    # only lines whose last character can end the pattern are trimmed, as most have nothing to trim ($ also stands before a last line separator)
    ends = F.rlike(F.substring("text", -1, 1), F.lit(r"[\s\u0085\u2028\u2029]"))
    return lines.withColumn("text", F.when(ends, F.regexp_replace("text", r"\s+$", "")).otherwise(F.col("text")))


def repeated_lines(lines: DataFrame, group: str = "paper_id", page: str = "page", share: float = 0.4) -> DataFrame:
    """(group, text, n_pages) of flattened line texts on at least max(2, int(share * pages of the group)) pages."""
    flat = lines.select(group, page, T.flat_space(F.col("text")).alias("text"))
    total = flat.groupBy(group).agg(F.count_distinct(page).alias("total"))
    on = flat.groupBy(group, "text").agg(F.count_distinct(page).alias("n_pages"))
    return on.join(total, group).where(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("total") * share))).select(group, "text", "n_pages")


def in_margin(top: Column, bottom: Column, height: Column) -> Column:
    return (top < height * 0.08) | (bottom > height * 0.90)


def _with_flat(lines: DataFrame) -> DataFrame:
    """lines with _edge and, where they may stand in a margin, their flattened text; no other line is ever compared."""
    edge = in_margin(F.col("top"), F.col("bottom"), F.col("page_height"))
    return lines.withColumn("_edge", edge).withColumn("_flat", F.when(F.coalesce("_edge", F.lit(True)), T.flat_space(F.col("text"))))


def page_texts(lines: DataFrame) -> DataFrame:
    """(paper_id, page, text, n, chars): lines and their characters by page and by margin text that may run (eight characters or more, no number; null for all other lines)."""
    may_run = F.col("_edge") & (F.length("_flat") >= 8) & ~F.col("_flat").rlike(T.PAGE_NUMBER)
    counted = _with_flat(lines).select("paper_id", "page", F.when(may_run, F.col("_flat")).alias("_text"), F.length(F.trim("text")).alias("_chars"))
    return counted.groupBy("paper_id", "page", F.col("_text").alias("text")).agg(F.count(F.lit(1)).alias("n"), F.sum("_chars").alias("chars"))


def strip_furniture(lines: DataFrame, gutter: float = 120.0, share: float = 0.4, pages: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Lines without running headers, footers and page numbers, of papers of two pages and more; one-page papers stay as they are.

    A margin line goes if its flattened text (eight characters or more, no
    number) stands in the margins of max(2, int(share * pages)) pages, if it is a
    number right of the gutter, or if it is known furniture.  pages: (paper_id,
    pages); without it a paper has as many pages as its last line says.  texts:
    `page_texts` of the lines, where they are at hand.
    """
    texts = page_texts(lines) if texts is None else texts
    total = pages.select("paper_id", F.col("pages").alias("_pages")) if pages is not None else texts.groupBy("paper_id").agg(F.max("page").alias("_pages"))
    # distinct pages of a text as aggregations with partial sums, as a running header may be on every page
    on = texts.where(F.col("text").isNotNull()).groupBy("paper_id", "text").agg(F.count("page").alias("_on")).join(total, "paper_id")
    on = on.where(F.col("_on") >= F.greatest(F.lit(2), F.floor(F.col("_pages") * share))).groupBy("paper_id").agg(F.collect_list("text").alias("_running"))
    # a row a paper, as few texts can be on that share of its pages: the lines move once, by the paper
    out = _with_flat(lines).join(total.join(on, "paper_id", "left"), "paper_id", "left")
    number = F.col("_flat").rlike(T.PAGE_NUMBER) & (F.col("x0") > gutter)
    repeated = F.coalesce(F.array_contains("_running", F.col("_flat")), F.lit(False))
    furniture = F.col("_edge") & (repeated | number | F.col("_flat").rlike(T.FURNITURE))
    return out.where((F.coalesce("_pages", F.lit(0)) < 2) | ~furniture).select(*lines.columns)


# ------------------------------------------------------------------ candidates
def candidates(lines: DataFrame, gutter: float = 120.0) -> DataFrame:
    """Lines left of the gutter that begin with a question number: numbered with a body of three characters, or a bare number."""
    number, body = F.regexp_extract("text", T.NUMBERED, 1), F.regexp_extract("text", T.NUMBERED, 2)
    bare = F.regexp_extract("text", T.BARE_NUMBER, 1)
    q = F.when(number != "", F.when(F.length(F.trim(body)) >= 3, number)).when(bare != "", bare)
    return lines.where(F.col("x0") <= gutter).withColumn("q_number", q.try_cast("int")).where(F.col("q_number").isNotNull()).select("paper_id", "q_number", "line_index", "page", "x0", "text")


def modal_gutter(found: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """Candidates within `tolerance` of their paper's most frequent rounded x0 (the first seen on ties); papers with fewer than three are left alone."""
    bucket = Window.partitionBy("paper_id", "_b")
    ranked = (
        found.withColumn("_b", F.bround("x0", 0)).withColumn("_n", F.count(F.lit(1)).over(bucket)).withColumn("_first", F.min("line_index").over(bucket))
        .withColumn("_mode", F.max_by("_b", F.struct("_n", -F.col("_first"))).over(_paper())).withColumn("_all", F.count(F.lit(1)).over(_paper()))
    )
    return ranked.where((F.col("_all") < 3) | (F.abs(F.col("x0") - F.col("_mode")) <= tolerance)).drop("_b", "_n", "_first", "_mode", "_all")


def best_chain(qs: list[int]) -> tuple[list[int], int]:
    """Positions of the best chain in qs, and its gaps; one step a number, as only the best chain that ends in each number matters."""
    size, gaps, before = [0] * len(qs), [0] * len(qs), [-1] * len(qs)
    best: dict[int, int] = {}
    top = -1
    for i, q in enumerate(qs):
        options = [(-1, 0, -1)] if q == 1 else [(-1, 1, -1)] if q == 2 else []
        options += [(-size[j] - 1, gaps[j] + g, j) for g in (0, 1) if (j := best.get(q - 1 - g)) is not None]
        if not options:
            continue
        n, gaps[i], before[i] = min(options)  # longest, fewest gaps, earliest predecessor
        size[i] = -n
        better = lambda k: k < 0 or (size[i], -gaps[i]) > (size[k], -gaps[k])  # noqa: B023, E731
        if better(best.get(q, -1)):
            best[q] = i
        if better(top):
            top = i
    path, i = [], top
    while i >= 0:
        path.append(i)
        i = before[i]
    return path[::-1], gaps[top] if top >= 0 else 0


@F.pandas_udf(_CHAIN)
def longest_chain(qs: pd.Series) -> pd.DataFrame:
    """struct(path: 0-based positions, gaps) of the longest chain in an array of numbers in reading order.

    Steps are +1, or +2 counted as a gap; a chain starts at 1, or at 2 counted
    as a gap.  Most numbers, then fewest gaps, then the earliest end win; among
    equal predecessors the earlier one.  As nested higher-order functions this
    took 18 s for 15,000 arrays, in Arrow batches it takes under one.
    """
    return pd.DataFrame([best_chain([] if q is None else list(q)) for q in qs], columns=["path", "gaps"])


def chains(found: DataFrame) -> DataFrame:
    """Per paper: n_candidates, n_gaps and `starts`, the chain's candidates as array<struct<line_index, q_number>>."""
    listed = found.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("line_index", "q_number"))).alias("c"))
    out = listed.withColumn("chain", longest_chain(F.col("c.q_number")))
    return out.select("paper_id", F.size("c").alias("n_candidates"), F.col("chain")["gaps"].alias("n_gaps"), F.transform(F.col("chain")["path"], lambda i: F.get("c", i)).alias("starts"))


# ------------------------------------------------------------------ questions
def segments(lines: DataFrame, chain: DataFrame) -> DataFrame:
    """Lines from the first start on, with the q_number whose half-open range they stand in."""
    starts = chain.where(F.col("paper_id").isNotNull()).select("paper_id", F.explode("starts").alias("s"))
    starts = starts.select("paper_id", F.col("s.line_index").alias("line_index"), F.col("s.q_number").alias("_q"))
    # starts stand among the lines, each before its own, so both move once, by the paper
    rows = lines.withColumn("_line", F.lit(True)).unionByName(starts.withColumn("_line", F.lit(False)), allowMissingColumns=True)
    w = _paper().orderBy("line_index", "_line").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("_line"), F.struct(F.col("_q").alias("q"), F.col("line_index").alias("at"))), ignorenulls=True).over(w)
    rows = rows.withColumn("_s", last).where(F.col("_line") & F.col("_s").isNotNull())
    return rows.withColumn("q_number", F.col("_s.q")).withColumn("is_start", F.col("_s.at") == F.col("line_index")).drop("_q", "_line", "_s")


def _mark() -> Column:
    return F.nullif(F.regexp_extract("text", T.MARKS, 1), F.lit("")).cast("int")


def questions(lines: DataFrame, chain: DataFrame, low_pages: DataFrame | None = None) -> DataFrame:
    """One row a question: text, hash, marks, parts, pages and crop box. low_pages: (paper_id, low_pages array<int>) that need OCR."""
    # what the patterns say of a line is found before the lines move, so that texts move only where they are asked for
    stripped, body = F.regexp_replace("text", r"^\s+|\s+$", ""), F.regexp_extract("text", T.NUMBERED, 2)
    part = lambda head: F.lower(F.nullif(F.regexp_extract(head, T.PART, 1), F.lit("")))
    told = {"_solid": (F.length(stripped) >= 3) & ~stripped.rlike(T.PAGE_NUMBER), "_plain": part(F.col("text")), "_headed": part(F.when(body != "", body).otherwise(F.col("text"))), "_mark": _mark()}
    body = segments(lines.withColumns(told), chain).withColumn("_part", F.when(F.col("is_start"), F.col("_headed")).otherwise(F.col("_plain")))
    line = F.struct("line_index", "text")
    q = body.groupBy("paper_id", "q_number").agg(
        F.min_by(F.struct("page", "top", "bottom"), "line_index").alias("first"),
        F.max_by(F.when(F.col("_solid"), F.col("page")), F.when(F.col("_solid"), F.col("line_index"))).alias("tail_page"),
        F.min("line_index").alias("start_index"),
        F.sum("_mark").cast("int").alias("marks_total"),
        F.array_sort(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("line_index", F.concat(F.lit("("), "_part", F.lit(")")).alias("p"))))).alias("parts"),
        F.array_sort(F.collect_list(line)).alias("lines"),
        F.collect_list(F.when(F.col("_solid"), F.struct("page", "bottom"))).alias("solid"),
    )
    nxt = Window.partitionBy("paper_id").orderBy("start_index")
    q = q.withColumn("next", F.lead("first").over(nxt))
    page_start = F.col("first.page")
    end = F.greatest(F.coalesce("tail_page", page_start), page_start)
    q = q.withColumn("_end", end)
    bottoms = F.transform(F.filter("solid", lambda s: s["page"] == F.col("_end")), lambda s: s["bottom"])
    low = F.coalesce(F.array_max(bottoms), F.col("first.bottom")) + 8.0
    back = F.col("next").isNotNull() & (F.col("next.page") < F.col("_end"))
    page_end = F.when(back, F.col("next.page")).otherwise(F.col("_end"))
    y_top = F.greatest(F.lit(0.0), F.col("first.top") - 8.0)
    y_bottom = F.when(back, F.col("next.top") - 4.0).when(F.col("next.page") == F.col("_end"), F.least(low, F.col("next.top") - 4.0)).otherwise(low)
    y_bottom = F.when(page_start == page_end, F.greatest(y_bottom, y_top + 12.0)).otherwise(y_bottom)
    full_text = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), r"^\s+|\s+$", "")
    out = q.select(
        "paper_id", "q_number", F.array_distinct(F.transform("parts", lambda x: x["p"])).alias("part_labels"), page_start.alias("page_start"), page_end.alias("page_end"),
        F.round(y_top, 2).alias("y_top"), F.round(y_bottom, 2).alias("y_bottom"), "marks_total", full_text.alias("full_text"), F.sha2(full_text, 256).alias("text_sha256"),
    )
    if low_pages is None:
        return out.withColumn("needs_ocr", F.lit(False))
    pages = F.sequence("page_start", F.greatest("page_end", "page_start"))
    hit = F.coalesce(F.arrays_overlap(pages, F.col("low_pages")), F.lit(False)) & (F.col("page_end") >= F.col("page_start"))
    return out.join(low_pages, "paper_id", "left").withColumn("needs_ocr", hit).drop("low_pages")


# ------------------------------------------------------------------ scores
def score_columns(n, n_candidates, n_gaps, with_marks, total_marks, expected_min=10, expected_max=13, paper_marks=100) -> dict[str, Column]:
    """The five signals of a split and their weighted sum, each to three decimals."""
    numbering = F.when(n_candidates > 0, 1.0 - F.least(F.lit(0.5), F.greatest(F.lit(0), n_candidates - n) / n_candidates)).otherwise(0.0)
    sequence = F.greatest(F.lit(0.0), 1.0 - 0.15 * n_gaps)
    marks = F.when(n > 0, with_marks / n).otherwise(0.0)
    off = F.when(n < expected_min, expected_min - n).when(n > expected_max, n - expected_max).otherwise(0)
    count = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - off / 5.0))
    total = F.greatest(F.lit(0.0), 1.0 - F.abs(total_marks - paper_marks) / 20.0)
    whole = 0.20 * numbering + 0.15 * sequence + 0.25 * marks + 0.20 * count + 0.20 * total
    named = {"numbering": numbering, "sequence": sequence, "marks": marks, "count": count, "marks_sum": total, "confidence": whole}
    return {k: F.round(v, 3) for k, v in named.items()}


def status(n_questions: Column, confidence: Column) -> Column:
    return F.when((n_questions > 0) & (confidence >= 0.6), "ok").when(n_questions > 0, "partial").otherwise("failed")


def missing_numbers(found: Column) -> Column:
    """What is missing of 1 to the largest number found, in order."""
    return F.when(F.size(found) > 0, F.array_except(F.sequence(F.lit(1), F.array_max(found)), found)).otherwise(F.array().cast("array<int>"))


def split_papers(lines: DataFrame, *, gutter: float = 120.0, tolerance: float = 6.0, expected_min: int = 10, expected_max: int = 13, paper_marks: int = 100,
                 low_pages: DataFrame | None = None, pages: DataFrame | None = None, low_text: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, papers): all questions with their paper's confidence, and one row a paper with signals, status and notes.

    pages: (paper_id, pages) of the papers; low_pages: (paper_id, low_pages) with the pages of too little text, or low_text: the
    characters below which a page has too little.  Only the lines left, counts and chains are written; the questions are made from them
    when they are asked for, and the papers take no text but the marks.
    """
    # what is counted of the lines and the lines left are read several times: written once, so that no stage is computed anew
    texts = tables.written(page_texts(lines), "texts")
    kept = tables.written(reading_order(strip_furniture(lines, gutter, pages=pages, texts=texts)), "lines")
    before, after = texts.groupBy("paper_id").agg(F.sum("n").alias("_all")), kept.groupBy("paper_id").agg(F.count(F.lit(1)).alias("_kept"))
    if low_pages is None and low_text is not None:
        chars = texts.groupBy("paper_id", "page").agg(F.sum("chars").alias("n"))
        low_pages = store.low_pages(chars, pages if pages is not None else texts.groupBy("paper_id").agg(F.max("page").alias("pages")), low_text)
    chain = tables.written(chains(modal_gutter(candidates(kept, gutter), tolerance)), "chains")
    found = questions(kept, chain, low_pages)
    # marks are read before the lines move, so that no text does
    marks = segments(kept.select("paper_id", "line_index", _mark().alias("_mark")), chain).groupBy("paper_id", "q_number").agg(F.sum("_mark").cast("int").alias("marks_total"))
    totals = marks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("marks_total") > 0).alias("with_marks"), F.coalesce(F.sum("marks_total"), F.lit(0)).alias("total_marks"), F.sort_array(F.collect_set("q_number")).alias("numbers"))
    papers = before.join(chain, "paper_id", "left").join(totals, "paper_id", "left")
    papers = papers.select("paper_id", "_all", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_candidates", "n_gaps", "n", "with_marks", "total_marks")], F.coalesce("numbers", F.array().cast("array<int>")).alias("numbers"))
    c = score_columns(F.col("n"), F.col("n_candidates"), F.col("n_gaps"), F.col("with_marks"), F.col("total_marks"), expected_min, expected_max, paper_marks)
    none = F.col("n") == 0
    papers = papers.withColumns(c | {"confidence": F.when(none, 0.0).otherwise(c["confidence"])})
    papers = papers.where(F.col("paper_id").isNotNull()).join(after, "paper_id", "left").withColumn("n_stripped", F.col("_all") - F.coalesce("_kept", F.lit(0))).drop("_all", "_kept")
    empty = F.array().cast("array<int>")
    papers = papers.join(low_pages, "paper_id", "left").withColumn("low_pages", F.coalesce("low_pages", empty)) if low_pages is not None else papers.withColumn("low_pages", empty)
    notes = F.filter(F.array(
        F.when(none, "no incrementing question numbers found in the gutter"),
        F.when(~none & ((F.col("n") < expected_min) | (F.col("n") > expected_max)), F.concat(F.col("n").cast("string"), F.lit(f" questions detected, outside the expected {expected_min}-{expected_max}"))),
        F.when(~none & (F.col("n_gaps") > 0), F.concat(F.lit("question number(s) not detected: ["), F.array_join(missing_numbers(F.col("numbers")), ", "), F.lit("]"))),
        F.when(~none & (F.col("total_marks") != paper_marks), F.concat(F.lit("marks total "), F.col("total_marks").cast("string"), F.lit(f", expected {paper_marks}"))),
        F.when(F.col("n_stripped") > 0, F.concat(F.col("n_stripped").cast("string"), F.lit(" running lines left out"))),
        F.when(F.size("low_pages") > 0, F.concat(F.lit("little text on page(s) "), F.array_join("low_pages", ", "))),
    ), lambda x: x.isNotNull())
    papers = papers.withColumn("notes", notes).withColumn("parse_status", status(F.col("n"), F.col("confidence")))
    return found.join(papers.select("paper_id", F.col("confidence").alias("extract_confidence")), "paper_id"), papers


# ------------------------------------------------------------------ crops
def page_slices(boxes: DataFrame, width: str | None = None) -> DataFrame:
    """One row a page of each question's crop: from y_top on the first, to y_bottom on the last, whole between."""
    out = boxes.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    out = out.withColumn("y0", F.when(F.col("page") == F.col("page_start"), F.col("y_top")).otherwise(0.0)).withColumn("y1", F.when(F.col("page") == F.col("page_end"), F.col("y_bottom")).otherwise(F.col("page_height")))
    return out if width is None else out.withColumn("scale_width", T.clamp(F.col(width), 320, 900))
