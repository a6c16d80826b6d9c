"""Replacement in place with kills between its steps, text search by trigrams, archives in SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lithic.operators import replacing, search
from lithic.plans import store_queries
from lithic.sources import zip_table

Q, T = "id long, paper_id long, q_number int", "question_id long, paper_id long, topic_code string"


def bank(spark, path, papers=12):
    q = [(p * 10 + k, p, k) for p in range(papers) for k in range(3)]
    replacing.create(path, spark.createDataFrame(q, Q), spark.createDataFrame([(i, p, c) for i, p, _ in q for c in "AB"], T), 5)
    return q


def stored(spark, path):
    return tuple(sorted(map(tuple, replacing.read(spark, path, n).collect())) for n in replacing.PARTS)


def files(path):
    """Data files of each bucket's folder, and when they were written."""
    found = {}
    for top, _, names in os.walk(path):
        if "bucket=" in top:
            found[os.path.relpath(top, path)] = sorted((n, os.stat(f"{top}/{n}").st_mtime_ns) for n in names if n.endswith(".parquet"))
    return found


def after(q):
    """Papers 3 and 7 replaced: 3 by one old and one new question, 7 by nothing."""
    new = [(30, 3, 9), (999, 3, 1)]
    left = sorted([r for r in q if r[1] not in (3, 7)] + new)
    ids = {r[0] for r in left}
    return left, sorted((i, p, c) for i, p, _ in q for c in "AB" if i in ids)


def replace(spark, path):
    papers = spark.createDataFrame([(3,), (7,), (7,), (None,)], "paper_id long")
    replacing.replace_papers(path, papers, spark.createDataFrame([(30, 3, 9), (999, 3, 1), (555, 4, 1)], Q), 5)


def test_only_the_folders_of_replaced_papers_change(spark, tmp_path):
    path = str(tmp_path / "bank")
    q = bank(spark, path)
    before = files(path)
    replace(spark, path)
    assert stored(spark, path) == after(q)
    hit = {f"bucket={r[0]}" for r in spark.createDataFrame([(3,), (7,)], "p long").select(replacing.bucket(F.col("p"), 5)).collect()}
    changed = {k.split("/")[1] for k in before.keys() | files(path).keys() if before.get(k) != files(path).get(k)}
    assert changed <= hit | {"bucket=None"} and changed and not os.path.exists(f"{path}/pending")
    replacing.replace_papers(path, spark.createDataFrame([], "paper_id long"), spark.createDataFrame([], Q), 5)
    assert stored(spark, path) == after(q)


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["mark", "after mark", "first table", "second table", "last"])
def test_a_kill_at_any_step_is_made_good(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "bank")
    q = bank(spark, path)
    untouched = stored(spark, path)

    def dies(*a, **kw):
        raise Killed

    if step == "mark":
        monkeypatch.setattr(replacing, "mark", dies)
    elif step == "after mark":
        real = replacing.recover
        calls = []
        monkeypatch.setattr(replacing, "recover", lambda *a: dies() if calls.append(1) or len(calls) == 2 else real(*a))
    else:
        real = replacing.tables.delete
        left = {"first table": 0, "second table": 1, "last": 2}[step]
        seen = []

        def delete(session, *paths):
            if len(seen) == left:
                if step == "first table":  # as a commit that has deleted a bucket and not yet put the new one there
                    real(session, *[f"{path}/questions/{d}" for d in os.listdir(f"{path}/pending/questions") if d.startswith("bucket")])
                raise Killed
            seen.append(paths)
            real(session, *paths)

        monkeypatch.setattr(replacing.tables, "delete", delete)
    with pytest.raises(Killed):
        replace(spark, path)
    monkeypatch.undo()
    assert stored(spark, path) == (untouched if step == "mark" else after(q))
    replace(spark, path)  # a replay
    assert stored(spark, path) == after(q)


def test_a_search_is_a_scan(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "a", "ab", "Abc", "xabcx", "ÉTÉ à Paris", *("".join(rng.choice("abcAB é") for _ in range(rng.randrange(30))) for _ in range(200))]
    df = spark.createDataFrame([(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(4, "abc again")], "id long, full_text string").repartition(3)
    path = str(tmp_path / "index")
    search.write_index(df, path)
    index = spark.read.parquet(path)
    for needle in (None, "", "  ", "a", "ab", "abc", "ABC", "été", "a b", "bca", "nothing", "cab", "%_", " abc "):
        low = (needle or "").strip().lower()
        want = sorted(repr((i, t)) for i, t in map(tuple, df.collect()) if not low or (t is not None and low in t.lower()))
        assert sorted(repr((r.id, r.full_text)) for r in search.search(df, index, needle).collect()) == want, needle
    some = search.candidates(index, "abca")
    assert 0 < some.count() < 100
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [abc,bca])]" in plan
    assert search.posted(df.limit(0)).count() == 0


def test_phrases_are_searched_in_one_pass_and_the_index_moves_nothing(spark, tmp_path):
    texts = [None, "", "ab", "a\x00\x00b", "Abc \U0001f600d", "xabcx ab", "ÉTÉ à Paris"]
    df = spark.createDataFrame([*enumerate(texts), (5, "abc again"), (None, "abc")], "id long, full_text string").repartition(2)
    path = str(tmp_path / "index")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan(search.posted(df)) and "Sort" not in plan(search.posted(df))
    search.write_index(df, path)
    index = spark.read.parquet(path)
    phrases = ["abc", "", "ab", "a\x00\x00", "\U0001f600D", "été ", "none at all"]
    found = search.search_all(df, index, phrases)
    assert plan(found).count("FileScan parquet") == 1
    want = [(i, p) for i, t in map(tuple, df.collect()) for p in phrases if not p or (t is not None and p.strip().lower() in t.lower())]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.collect())


def test_lines_are_numbered_once_for_a_stored_bank(spark, monkeypatch):
    from lithic.plans import bank_queries

    calls, real = [], bank_queries.numbered
    monkeypatch.setattr(bank_queries, "numbered", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(replacing, "create", lambda path, questions, tags: [df._jdf.queryExecution().optimizedPlan() for df in (questions, tags)])

    class Seen(Exception):
        pass

    def seen(path, papers, questions):
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (papers, questions)]
        assert not any("Window" in p for p in plans)
        raise Seen

    monkeypatch.setattr(replacing, "replace_papers", seen)
    with pytest.raises(Seen):
        store_queries.replaced_in_place(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_archives_in_sql(spark):
    end = bytes.fromhex("504B0506") + bytes(18)
    spark.createDataFrame([(1, b"no archive"), (2, None), (3, end)], "id long, content binary").createOrReplaceTempView("some_archives")
    got = spark.sql(f"SELECT id, m.* FROM some_archives, LATERAL {zip_table.register(spark)}(content) m").collect()
    assert [(r.id, r.name) for r in got] == [(1, None)] and "no end of central directory" in got[0].error


def test_queries_have_sql():
    assert store_queries.QUERIES.keys() == store_queries.ORACLE_SQL.keys()
