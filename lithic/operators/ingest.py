"""Links to papers: grouping, selection, ingest states, upserts and free file names."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.functions import text as T
from lithic.operators import tables


# ------------------------------------------------------------------ discovery
def union_until(sources: list[DataFrame | Callable[[], DataFrame]], target: int, key: str = "exam_key", failed: list[str] | None = None) -> DataFrame:
    """Union of sources in order, up to and including the one that brings the distinct keys to `target`.

    Counts run on the driver one source at a time, as later sources need not be
    read at all; the distinct keys so far are kept, at most `target` of them.  A
    source may be a function; one that fails gives no links, and its error is
    appended to `failed`.
    """
    taken: list[DataFrame] = []
    keys: set = set()
    for s in sources:
        try:
            df = s() if callable(s) else s
            new = [r[0] for r in df.where(~F.col(key).isin(sorted(keys)) if keys else F.lit(True)).select(key).where(F.col(key).isNotNull()).distinct().limit(target).collect()]
        except Exception as x:  # a source that cannot be read is logged and left out
            if failed is None:
                raise
            failed.append(f"{type(x).__name__}: {str(x)[:300]}")
            continue
        taken.append(df)
        keys |= set(new)
        if len(keys) >= target:
            break
    if not taken:
        raise ValueError("no source could be read")
    return reduce(DataFrame.unionByName, taken)


def first_groups(links: DataFrame, group: str, key: str, order: str, target: int) -> DataFrame:
    """Links of the first groups (by first appearance) up to the one in which `target` distinct keys are reached; the last group is whole."""
    key_first = links.groupBy(key).agg(F.min(order).alias("_o"), F.min_by(group, order).alias(group))
    # at most one row a key reaches this window, and only keys among the first `target` matter
    cut = key_first.orderBy("_o").limit(target).groupBy().agg(F.when(F.count(F.lit(1)) >= target, F.max_by(group, "_o")).alias("_last"))
    starts = links.groupBy(group).agg(F.min(order).alias("_start"))
    end = starts.join(F.broadcast(cut), F.col(group) == F.col("_last")).select(F.col("_start").alias("_end"))
    bound = F.broadcast(end.agg(F.min("_end").alias("_end")))
    return links.join(starts, group).crossJoin(bound).where(F.col("_end").isNull() | (F.col("_start") <= F.col("_end"))).drop("_start", "_end")


def gated(links: DataFrame, pages: DataFrame, phrases: list[str], text_col: str = "text", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(links, errors): none of the links and one error if the first page shows one of the phrases; else all and none."""
    first = pages.agg(F.min_by(F.lower(text_col), order).alias("t"))
    hit = first.select(reduce(lambda a, b: a | b, [F.contains("t", F.lit(p)) for p in phrases]).alias("gate")).select(F.coalesce("gate", F.lit(False)).alias("gate"))
    ok, bad = hit.where(~F.col("gate")).select(F.lit(1).alias("_g")), hit.where("gate")
    return links.join(F.broadcast(ok), F.lit(True), "left_semi"), bad.select(F.lit("login required: the first page hides its links").alias("error"))


def newest_first(links: DataFrame) -> DataFrame:
    return links.orderBy(F.coalesce("year", F.lit(0)).desc(), F.col("school_code").desc())


# ------------------------------------------------------------------ groups
def exam_groups(links: DataFrame, order: str = "ord") -> DataFrame:
    """One row an exam: header of its first link and measures of how complete it is.

    Two levels of aggregation, by (exam, paper) and by exam, so partial sums
    shrink before either exchange; a null paper is a paper.
    """
    per_paper = links.groupBy("exam_key", "paper_no").agg(
        F.min_by(F.struct("school", "school_code", "year", "exam_type", "source"), order).alias("head"), F.min(order).alias("ord"),
        F.collect_set("doc_type").alias("docs"), F.count(F.lit(1)).alias("n_links"), F.coalesce(F.sum("member_bytes"), F.lit(0)).alias("bytes"),
    )
    has = lambda x: F.array_contains("docs", x)
    complete = has("combined") | (has("qp") & has("ms"))
    label = F.coalesce(F.col("paper_no").cast("string"), F.lit("x"))
    return per_paper.groupBy("exam_key").agg(
        F.min_by("head", "ord").alias("head"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n_papers"), F.count_if(complete).alias("complete_papers"),
        F.bool_or(has("qp") | has("combined")).alias("any_qp"), F.sum("n_links").alias("n_links"), F.sum("bytes").alias("uncompressed_bytes"),
        F.array_join(F.array_sort(F.collect_list(F.concat(label, F.lit(":"), F.array_join(F.array_sort("docs"), "+")))), " ").alias("papers"),
    ).select("exam_key", "head.*", "ord", "n_papers", "complete_papers", "any_qp", "n_links", "uncompressed_bytes", "papers")


def usable(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("any_qp") & (F.col("school_code") != "UNK"))


def _rank() -> list[Column]:
    return [F.col("year").desc(), F.col("complete_papers").desc(), F.col("n_papers").desc(), F.col("school_code").asc(), F.col("exam_key").asc()]


def select_groups(groups: DataFrame, cap: int, per: str = "school_code") -> DataFrame:
    """The best group of each school first, then the rest in the same order, at most `cap`."""
    w = Window.partitionBy(per).orderBy(*_rank())
    ranked = usable(groups).withColumn("repeat", F.row_number().over(w) > 1)
    return ranked.orderBy("repeat", *_rank()).limit(cap)


def select_listed(groups: DataFrame, codes: list[str], cap: int) -> DataFrame:
    """Groups of the asked codes in the order asked; of one code the last group counts."""
    asked = list(dict.fromkeys(c for c in (x.strip().upper() for x in codes) if c))
    if not asked:
        return usable(groups).limit(0).withColumn("pos", F.lit(0))
    last = usable(groups).where(F.col("school_code").isin(asked)).groupBy("school_code").agg(F.max_by(F.struct(*groups.columns), "ord").alias("g")).select("g.*")
    return last.withColumn("pos", F.array_position(F.array(*map(F.lit, asked)), F.col("school_code"))).orderBy("pos").limit(cap)


# ------------------------------------------------------------------ ingest
#: Links that one task may walk through, holding their URLs and hashes.
FEW = 100_000


def _walked(open_: DataFrame) -> DataFrame:
    """Of at most `FEW` links (url, sha, _r) those that are stored, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        urls, shas = set(), set()
        for pdf in batches:
            keep = []
            for url, sha in zip(pdf["url"], pdf["sha"], strict=True):
                keep.append(url not in urls and sha not in shas)
                if keep[-1]:
                    urls.add(url)
                    shas.add(sha)
            yield pdf[keep]

    flat = open_.select("url", "sha", "_r.o", "_r.i").repartition(1).sortWithinPartitions("o", "i")
    return flat.mapInPandas(run, flat.schema).select("url", "sha", F.struct("o", "i").alias("_r"))


def ingest_states(links: DataFrame, known_urls: DataFrame, known_shas: DataFrame, max_bytes: int, order: str = "ord") -> DataFrame:
    """state of each link (url, sha, size, failed): skipped, failed, refused, duplicate or new; links count in input order.

    A link is stored if it can be and no earlier stored link has its URL or its
    hash.  Each round stores those links that are the first of the undecided
    ones both by URL and by hash, and decides all others of these URLs and
    hashes; few links are left after the first round.  Minima are aggregated,
    so a hot URL or hash meets in no task.  Once at most `FEW` links are open,
    one task walks through them, so long chains of conflicts add no rounds.
    """
    base = links.withColumn("_r", F.struct(F.col(order).alias("o"), F.monotonically_increasing_id().alias("i")))
    base = base.join(known_urls.select("url").distinct().withColumn("_u", F.lit(True)), "url", "left").join(known_shas.select("sha").distinct().withColumn("_s", F.lit(True)), "sha", "left")
    bad = F.col("failed") | F.col("sha").isNull()
    base = tables.written(base, "links")
    open_ = base.where(F.col("_u").isNull() & F.col("_s").isNull() & ~bad & (F.col("size") < max_bytes)).select("url", "sha", "_r")
    stored = []
    while left := open_.count():
        if left <= FEW:
            stored.append(tables.written(_walked(open_), "stored"))
            break
        by_url, by_sha = (open_.groupBy(k).agg(F.min("_r").alias(f"_{k}")) for k in ("url", "sha"))
        firsts = open_.join(by_url, "url").join(by_sha, "sha").where((F.col("_r") == F.col("_url")) & (F.col("_r") == F.col("_sha"))).select("url", "sha", "_r")
        stored.append(tables.written(firsts, "stored"))
        last, open_ = open_, tables.written(open_.join(stored[-1].select("url"), "url", "left_anti").join(stored[-1].select("sha"), "sha", "left_anti"), "open")
        tables.drop(last)
    stored = stored or [open_]
    kept = reduce(DataFrame.unionByName, stored).select("url", F.col("_r").alias("_kept"))  # one link a URL
    out = base.join(kept, "url", "left")
    seen = F.col("_u").isNotNull() | F.coalesce(F.col("_kept") < F.col("_r"), F.lit(False))
    state = F.when(seen, "skipped").when(bad, "failed").when(F.col("size") >= max_bytes, "refused").when(F.col("_kept") == F.col("_r"), "new").otherwise("duplicate")
    return out.select(*links.columns, state.alias("state"))


def unique_by_sha(rows: DataFrame, sha: str = "sha", order: str = "ord") -> DataFrame:
    """The first row of each hash and how many share it, as one aggregation (no window over a hot hash)."""
    return rows.groupBy(sha).agg(F.min_by(F.struct(*[c for c in rows.columns if c != sha]), order).alias("r"), F.count(F.lit(1)).alias("n")).select(sha, "r.*", "n")


SUFFIXES = ("", "_b", "_c", "_d", "_e")


def free_names(rows: DataFrame, taken: DataFrame, name: str = "name", sha: str = "sha", order: str = "ord") -> DataFrame:
    """rel_path of each row: the first of its name and its name with _b to _e that is free or holds the same bytes; null if none is, for the caller to refuse.

    taken: (name, sha) of the files there are.  Rows count in input order and
    take names as they come.  After the first `len(SUFFIXES)` hashes of a name
    all its paths are full, and what is in a full path stays; so only these
    are looked at together, with the names that suffixes could lead to, and
    every hash, a later one too, has the first path that holds it in the end.
    """
    stem = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)
    extension = F.regexp_extract(name, r"(\.[^.]*)?$", 1)
    root = F.concat(F.regexp_replace(stem, r"(_[b-e])+$", ""), extension)
    first = rows.groupBy(F.col(name).alias("n"), F.col(sha).alias("s")).agg(F.min(order).alias("o"))
    wanted = first.withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("o", "s"))).where(F.col("k") <= len(SUFFIXES))
    left = wanted.withColumn("root", F.regexp_replace("n", r"(_[b-e])+(\.[^.]*)?$", "$2"))
    right = taken.select(F.col(name).alias("n"), F.col(sha).alias("s"), root.alias("root"))
    kind = f"n string, s {rows.schema[sha].dataType.simpleString()}, rel_path string"

    def settle(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        there = dict(zip(old["n"], old["s"], strict=True))
        paths = {}
        for n, s in new.sort_values(["o", "n"])[["n", "s"]].itertuples(index=False):
            head, dot, tail = n.rpartition(".")
            paths[n] = [f"{head}{x}{dot}{tail}" if dot else f"{n}{x}" for x in SUFFIXES]
            for path in paths[n]:
                if there.setdefault(path, s) == s:
                    break
        out = []
        for n, some in paths.items():
            held = {}
            for path in some:
                if path in there:
                    held.setdefault(there[path], path)
            out += [(n, s, path) for s, path in held.items()]
        return pd.DataFrame(out, columns=["n", "s", "rel_path"])

    placed = left.groupBy("root").cogroup(right.groupBy("root")).applyInPandas(settle, kind)
    return rows.join(placed.select(F.col("n").alias(name), F.col("s").alias(sha), "rel_path"), [name, sha], "left").select(*rows.columns, "rel_path")


# ------------------------------------------------------------------ upserts
def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """old with `update` columns taken from the last new row of each key (by `ord`), and new keys appended; other columns of old stay.

    Keys compare null-safely.  The result is a whole table to be written aside
    and swapped in, as plain Parquet has no update in place.
    """
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in old.columns if c not in keys]), "ord").alias("_n"))
    a, b = old.alias("a"), last.alias("b")
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = a.withColumn("_in", F.lit(True)).alias("a").join(b, cond, "full")
    here = F.col("a._in").isNotNull()
    cols = [F.when(here, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c not in keys:
            got = F.col(f"b._n.{c}")
            cols.append((F.when(F.col("b._n").isNotNull(), got).otherwise(F.col(f"a.{c}")) if c in update else F.when(here, F.col(f"a.{c}")).otherwise(got)).alias(c))
    return both.select(*cols).select(*old.columns)


#: What a paper that is known already takes from a new row; its hash, source and link stay.
DESCRIPTIVE = ("school", "school_code", "year", "exam_type", "paper_no", "doc_type", "rel_path", "pages", "size_bytes")


def upsert_papers(old: DataFrame, new: DataFrame, update: list[str] | None = None) -> DataFrame:
    """Papers after the rows of new have come in one by one, in the order of `ord`.

    A row belongs to the paper with its hash or, where there is none, to the one
    with its (source, source_url), be it old or brought by an earlier row; that
    paper takes the columns of `update` (by default those of `DESCRIPTIVE` that
    there are) from the last such row.  A row without a paper becomes one, with a
    null id for the caller to number.  Hashes are looked up as they were when the
    batch began, also where `update` changes them.  Rows without a hash are left
    out; a null source or link is equal to nothing.  Old papers keep their ids.
    """
    rest = [c for c in old.columns if c != "id"]
    update = [c for c in DESCRIPTIVE if c in rest] if update is None else update
    link = F.struct("source", "source_url")
    given = tables.written(new.where(F.col("file_sha256").isNotNull()), "new")
    by_sha = old.groupBy("file_sha256").agg(F.min("id").alias("_a"))
    by_link = old.groupBy("source", "source_url").agg(F.min("id").alias("_b"))
    found = given.join(by_sha, "file_sha256", "left").join(by_link, ["source", "source_url"], "left").withColumn("_id", F.coalesce("_a", "_b"))
    named = F.when(F.col("source").isNotNull() & F.col("source_url").isNotNull(), F.to_json(link))
    found = tables.written(found.withColumn("_link", F.coalesce(named, F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))), "found")
    taken = lambda n: [(F.when(F.col(n).isNotNull(), F.col(f"{n}.{c}")).otherwise(F.col(c)) if c in update else F.col(c)).alias(c) for c in rest]
    # of the rows without an old paper the first of its hash and of its link becomes one, with what earlier ones have left open
    open_ = found.where(F.col("_id").isNull())
    links = tables.written(open_.select("ord", F.col("_link").alias("url"), F.col("file_sha256").alias("sha"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("failed"), F.struct(*rest).alias("_row")), "links")
    nothing = links.limit(0)
    first = tables.written(ingest_states(links, nothing.select("url"), nothing.select("sha"), 1).where("state = 'new'").select("url", "sha", "ord", "_row"), "first")
    # each row's paper: old by hash, new by hash, old by link, new by link
    own = F.struct(*[F.col(c).alias(c) for c in update])
    rows = found.select("_a", "_b", "_link", "file_sha256", F.col("ord").alias("_ord"), own.alias("_values"))
    rows = rows.join(first.select(F.col("sha").alias("file_sha256"), F.col("ord").alias("_so")), "file_sha256", "left").withColumn("_s", F.when(F.col("_so") < F.col("_ord"), F.col("file_sha256")))
    rows = rows.join(first.select(F.col("url").alias("_link"), F.col("sha").alias("_u"), F.col("ord").alias("_uo")), "_link", "left")
    old_paper = F.coalesce("_a", F.when(F.col("_s").isNull(), F.col("_b")))
    new_paper = F.when(F.col("_a").isNull(), F.coalesce("_s", F.when(F.col("_b").isNull() & (F.col("_uo") < F.col("_ord")), F.col("_u"))))
    aimed = tables.written(rows.select(old_paper.alias("_old"), new_paper.alias("_new"), "_ord", "_values"), "aimed")
    last = lambda key: aimed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("_values", "_ord").alias("_n"))
    kept = old.join(last("_old"), F.col("id") == F.col("_old"), "left").select("id", *taken("_n"))
    fresh = first.join(last("_new"), F.col("sha") == F.col("_new"), "left").select("_row.*", "_n")
    return kept.unionByName(fresh.select(F.lit(None).cast(old.schema["id"].dataType).alias("id"), *taken("_n")))


def apply_geometry(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(questions with the new values, one row with how many changed): known keys only, null-safe."""
    changed = changed_rows(old, new, keys, values).select(*keys, F.struct(*values).alias("_v"))
    out = old.join(changed, keys, "left")
    cols = [(F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)) for c in old.columns]
    return out.select(*cols), changed.agg(F.count(F.lit(1)).alias("changed"))


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New rows of known keys whose values differ null-safely."""
    a, b = old.select(*keys, *values).alias("a"), new.alias("b")
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    differ = reduce(lambda x, y: x | y, [~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values])
    return b.join(a, cond).where(differ).select("b.*")


def same_signature(old: DataFrame, new: DataFrame) -> DataFrame:
    """(paper_id, same): whether a paper's ordered (q_number, text_sha256) are as before."""
    sig = lambda df, name: df.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("q_number", "text_sha256"))).alias(name))
    return sig(old, "x").join(sig(new, "y"), "paper_id", "full").select("paper_id", F.col("x").eqNullSafe(F.col("y")).alias("same"))


def replace_partitions(old: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """Rows of `new` in place of all old rows of their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_questions(questions: DataFrame, new: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, tags) after a paper's questions have been replaced: tags of questions that are gone go too."""
    out = replace_partitions(questions, new)
    return out, tags.join(out.select(F.col("id").alias("question_id")), "question_id", "left_semi")


def crawl_log(links: DataFrame, run_at: Column, most: int = 1000) -> DataFrame:
    """One row a source: links seen, distinct exams, number of errors, and the first `most` distinct errors as a sorted JSON list."""
    counts = links.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("urls_seen"), F.count_distinct("exam_key").alias("new_papers"), F.count("error").alias("n_errors"))
    errors = links.where(F.col("error").isNotNull()).select("source", "error").distinct()
    first = errors.withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy("error"))).where(F.col("_k") <= most)
    listed = first.groupBy("source").agg(F.to_json(F.array_sort(F.collect_list("error"))).alias("errors"))
    return counts.join(listed, "source", "left").withColumn("errors", F.coalesce("errors", F.lit("[]"))).withColumn("run_at", run_at)


def append_crawl_log(log: DataFrame, path: str) -> None:
    """Add a run's rows to the log's folder; earlier runs stay."""
    log.write.mode("append").parquet(path)


def candidates_order(groups: DataFrame) -> DataFrame:
    """Groups as the candidates file lists them: newest first, then the most complete, then by code."""
    return groups.orderBy(F.col("year").desc(), F.col("complete_papers").desc(), "school_code")


def candidates_json(groups: DataFrame, path: str) -> bool:
    """Write groups as JSON; an empty result never replaces an earlier one. Whether it was written."""
    if groups.isEmpty():
        return False
    groups.write.mode("overwrite").json(path)
    return True


def summary(states: DataFrame, col: str = "state") -> DataFrame:
    return states.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def links_with_keys(links: DataFrame) -> DataFrame:
    return links.withColumn("exam_key", T.exam_key(F.col("school_code"), F.col("year"), F.col("exam_type"))).withColumn("key", T.paper_key(F.col("school_code"), F.col("year"), F.col("exam_type"), F.col("paper_no")))
