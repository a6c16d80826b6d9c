"""Papers and links that come in one by one, in batches, and again after failures."""

import random

import pytest

from lithic import streaming
from lithic.operators import ingest, tables

PAPER = "id long, source string, source_url string, file_sha256 string, school string, rel_path string, parse_status string"
NEW = PAPER.replace("id long, ", "") + ", ord int"


def one_by_one(old, new):
    papers = [list(p) for p in old]
    for source, url, sha, school, path, status, _ in sorted(new, key=lambda r: r[-1]):
        if sha is None:
            continue
        hit = next((p for p in papers if p[3] == sha), None) or next((p for p in papers if source is not None and url is not None and p[1] == source and p[2] == url), None)
        if hit:
            hit[4], hit[5] = school, path
        else:
            papers.append([None, source, url, sha, school, path, status])
    return sorted(map(repr, map(tuple, papers)))


def test_papers_come_in_one_by_one(spark):
    rng = random.Random(7)
    for size in (0, 3, 150):
        old = [(i, "ab"[i % 2], f"u{i}", f"h{i}", "s", f"p{i}", "ok") for i in range(6)]
        pick = lambda kind, n: rng.choice([None, *(f"{kind}{k}" for k in range(n))])
        new = [(rng.choice("ab"), pick("u", 30), pick("h", 40), f"s{k}", f"q{k}", "pending", k) for k in range(size)]
        got = ingest.upsert_papers(spark.createDataFrame(old, PAPER), spark.createDataFrame(new, NEW).repartition(3))
        assert sorted(map(repr, map(tuple, got.collect()))) == one_by_one(old, new)
    none = ingest.upsert_papers(spark.createDataFrame([], PAPER), spark.createDataFrame(new, NEW))
    assert sorted(map(repr, map(tuple, none.collect()))) == one_by_one([], new)


class Killed(Exception):
    pass


@pytest.mark.parametrize("place", ["saveAsTable", "sql"])
def test_a_replay_loses_nothing(spark, monkeypatch, place):
    table = f"held_{place.lower()}"
    put = streaming.upsert_batches(lambda old, new: ingest.upsert(old, new, ["id"], ["v"]), table)
    batch = lambda *rows: spark.createDataFrame(rows, "id int, v string, ord int")
    rows = lambda: sorted(map(tuple, spark.table(table).collect()))
    put(batch((1, "a", 0), (2, "b", 0)), 0)
    owner = type(spark.range(1).write) if place == "saveAsTable" else type(spark)
    real = getattr(owner, place)

    def dies(self, first, *a, **kw):
        if place == "sql" and not first.startswith("CREATE OR REPLACE VIEW"):
            return real(self, first, *a, **kw)
        if place == "saveAsTable":
            real(self, first, *a, **kw)  # written, but the view is not replaced
        raise Killed

    monkeypatch.setattr(owner, place, dies)
    with pytest.raises(Killed):
        put(batch((2, "c", 0), (3, "d", 0)), 1)
    assert rows() == [(1, "a"), (2, "b")]  # whole, as it was
    monkeypatch.undo()
    for _ in range(2):  # the replay, and one of an epoch that is done
        put(batch((2, "c", 0), (3, "d", 0)), 1)
        assert rows() == [(1, "a"), (2, "c"), (3, "d")]
    put(batch((1, "z", 0)), 2)
    assert rows() == [(1, "z"), (2, "c"), (3, "d")]
    assert len([t for t in spark.catalog.listTables() if t.name.startswith(f"{table}_v")]) == 2


def test_a_plain_table_becomes_the_first_version(spark):
    spark.createDataFrame([(1, "a")], "id int, v string").write.saveAsTable("plain_one")
    put = streaming.upsert_batches(lambda old, new: ingest.upsert(old, new, ["id"], ["v"]), "plain_one")
    put(spark.createDataFrame([(2, "b", 0)], "id int, v string, ord int"), 5)
    assert sorted(map(tuple, spark.table("plain_one").collect())) == [(1, "a"), (2, "b")]


def test_a_stream_of_links_has_the_states_of_all_at_once(spark, tmp_path):
    rng = random.Random(11)
    schema = "ord int, url string, sha string, size long, failed boolean"
    rows = [(i, f"u{rng.randrange(25)}", rng.choice([None, *(f"s{k}" for k in range(25))]), rng.choice([5, 5, 5, 200]), rng.random() < 0.1) for i in range(160)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(0, 160, 40):
        spark.createDataFrame(rows[k : k + 40], schema).coalesce(1).write.mode("append").parquet(src)
    old = spark.createDataFrame([("u3", "s4")], "url string, sha string")
    put = streaming.ingest_batches(out, 100, old, old)
    again = []

    def each(batch, epoch):
        put(batch, epoch)
        if epoch == 2:
            again.append(epoch)
            put(batch, epoch)  # a replay

    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.ord: r.state for r in spark.read.parquet(out).collect()}
    want = {r.ord: r.state for r in ingest.ingest_states(spark.createDataFrame(rows, schema), old, old, 100).collect()}
    assert again and got == want and len(got) == 160


def test_tables_that_are_dropped_are_gone(spark):
    with tables.recording() as made:
        a = tables.written(spark.range(3), "a")
    assert len(made) == 1 and tables.exists(spark, made[0])
    tables.drop(a)
    assert not tables.exists(spark, made[0])


@pytest.mark.parametrize("few", [0, 4])
def test_rounds_decide_what_a_walk_decides(spark, monkeypatch, few):
    rng = random.Random(13)
    schema = "ord int, url string, sha string, size long, failed boolean"
    rows = [(i, f"u{rng.randrange(12)}", f"s{rng.randrange(12)}", 5, False) for i in range(60)]
    df, none = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame([], "url string, sha string")
    states = lambda: [r.state for r in ingest.ingest_states(df, none, none, 100).orderBy("ord").collect()]
    walked = states()
    monkeypatch.setattr(ingest, "FEW", few)
    assert states() == walked and {"new", "skipped", "duplicate"} <= set(walked)
